"""Invariants and small cases of the catalog operators, and the sources and sinks on real files."""

import difflib
import hashlib
import json
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from concordat import bindings as b
from concordat import queries_files, queries_sources
from concordat.functions import similarity
from concordat.functions import text as T
from concordat.operators import catalog, duplicates, linkage, playlists, postings, reconcile
from concordat.plans import exports, versions
from concordat.sources import feeds, files
from concordat.tables import tables_made

from .conftest import SF


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@settings(max_examples=200, deadline=None)
@given(st.text("abcé ", max_size=20), st.text("abcé ", max_size=20))
def test_lcs_length(a, b_):
    table = [[0] * (len(b_) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b_):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    assert similarity.lcs_length(a, b_) == similarity.lcs_length(b_, a) == table[-1][-1]


def test_ratios(spark):
    df = spark.createDataFrame([("kitten", "sitting"), ("", ""), ("", "x"), ("radio edit", "radio mix"), (None, "x")], "a string, b string")
    got = df.select(similarity.indel_ratio(F.col("a"), F.col("b")), similarity.matching_blocks_ratio(F.col("a"), F.col("b"))).collect()
    assert [round(r[0], 6) if r[0] is not None else None for r in got] == [0.615385, 1.0, 0.0, 0.736842, None]
    assert got[0][1] == difflib.SequenceMatcher(None, "kitten", "sitting").ratio()


@pytest.mark.parametrize(
    "name, artist, title",
    [("A - B - C", "A", "B - C"), ("A – B", "A", "B"), ("Song by Someone", "Song", "Someone"), ("plain", "", "plain"), (" x ", "", "x")],
)
def test_split_artist_title(spark, name, artist, title):
    got = spark.createDataFrame([(name,)], "n string").select(T.split_artist_title(F.col("n")).alias("s")).select("s.*").first()
    assert tuple(got) == (artist, title)


@pytest.mark.parametrize(
    "title, base, version",
    [("Song (Club Mix)", "Song", "club mix"), ("Song [VIP] (live)", "Song (live)", "vip"), ("Song - Radio Edit", "Song", "radio edit"), ("Song (live)", "Song (live)", "")],
)
def test_version_split(spark, title, base, version):
    got = spark.createDataFrame([(title,)], "n string").select(T.version_split(F.col("n")).alias("s")).select("s.*").first()
    assert tuple(got) == (base, version)


def test_small_text_rules(spark):
    df = spark.createDataFrame([("a/b\\c.MP3", "01:02:03", 61000, "Héllo (Explicit) [x]!", "AC/DC: Live?")], "p string, d string, ms long, t string, n string")
    got = df.select(
        T.extension(F.col("p")), T.stem(F.col("p")), T.duration_seconds(F.col("d")), T.duration_label(F.col("ms")), T.fingerprint_norm(F.col("t")),
        T.name_norm(similarity.strip_accents(F.col("t"))), T.file_safe(F.col("n")), T.ancestors(F.lit("x/y/z")), T.stars(F.lit(3.7)),
    ).first()
    assert tuple(got) == ("mp3", "c", 3723, "1:01", "héllo", "hello explicit x", "AC_DC_ Live_", ["x", "x/y", "x/y/z"], 153)


def test_diff_and_apply(spark):
    stored, new = b.tracks(spark, SF), b.incoming(spark, SF)
    compare, carry = ["title", "artists", "album", "duration_ms"], ["added_at", "is_local", "track_id"]
    plan = reconcile.snapshot_diff(stored, new, "uri", compare, carry)
    stats = reconcile.plan_stats(plan).first()
    assert sum(stats) == stored.select("uri").union(new.select("uri")).distinct().count()
    applied = reconcile.apply_snapshot(stored, plan, "uri", compare, carry)
    assert rows(applied.select("uri", *compare)) == rows(new.select("uri", *compare))
    again = reconcile.plan_stats(reconcile.snapshot_diff(applied, new, "uri", compare)).first()
    assert (again["added"], again["updated"], again["deleted"]) == (0, 0, 0)


def test_diff_treats_null_as_a_value(spark):
    old = spark.createDataFrame([(1, None), (2, "a"), (None, "x")], "k int, v string")
    new = spark.createDataFrame([(1, "a"), (2, "a"), (3, None)], "k int, v string")
    got = {r["k"]: r["action"] for r in reconcile.snapshot_diff(old, new, "k", ["v"]).collect()}
    assert got == {1: "update", 2: "unchanged", 3: "add"}


def test_membership_round(spark):
    stored, new = b.pairs(spark, SF), b.incoming_pairs(spark, SF)
    changed = reconcile.changed_parents(b.playlists(spark, SF), b.incoming_playlists(spark, SF), "playlist_id", "token")
    diff = reconcile.membership_diff(stored, new, b.tracks(spark, SF), changed, "uri", "playlist_id")
    applied = reconcile.apply_membership(stored, diff, "uri", "playlist_id")
    assert reconcile.membership_diff(applied, new, b.tracks(spark, SF), changed, "uri", "playlist_id").count() == 0
    other = stored.join(changed, "playlist_id", "left_anti").select("uri", "playlist_id")
    assert rows(applied.join(changed, "playlist_id", "left_anti").select("uri", "playlist_id")) == rows(other)


def test_assignment_is_one_to_one(spark):
    spark.sparkContext.setCheckpointDir(spark.sparkContext.getConf().get("spark.checkpoint.dir"))
    found = spark.createDataFrame([("f1", "a", 0.9), ("f2", "a", 0.95), ("f1", "b", 0.8), ("f3", "a", 0.95), ("f3", "b", 0.7)], "file_path string, uri string, confidence double")
    got = {(r["file_path"], r["uri"]) for r in linkage.assign_one_to_one(found).collect()}
    assert got == {("f2", "a"), ("f1", "b")}
    odd = spark.createDataFrame([("f1", None, 1.0), (None, "a", 1.0), ("f1", "b", None)], found.schema)
    for rest in (100, 2):
        got = sorted((r["file_path"], r["uri"]) for r in linkage.assign_one_to_one(found.unionByName(found).unionByName(odd), rest).collect())
        assert got == [("f1", "b"), ("f2", "a")]


def greedy(pairs):
    files, uris, out = set(), set(), set()
    for f, u, c in sorted(pairs, key=lambda x: (-x[2], x[1], x[0])):
        if f not in files and u not in uris:
            files.add(f)
            uris.add(u)
            out.add((f, u))
    return out


@pytest.mark.parametrize("rest", [100_000, 8])
def test_assignment_goes_on_until_none_is_left(spark, rest):
    spark.sparkContext.setCheckpointDir(spark.sparkContext.getConf().get("spark.checkpoint.dir"))
    n = 60 if rest > 100 else 12  # every file ranks the same tracks alike
    pairs = [(f"f{i:02}", f"u{j:02}", 1 - j / 100) for i in range(n) for j in range(n)]
    got = {(r["file_path"], r["uri"]) for r in linkage.assign_one_to_one(spark.createDataFrame(pairs, "file_path string, uri string, confidence double"), rest).collect()}
    assert len(got) == n and got == greedy(pairs)
    rng = random.Random(4)
    pairs = [(f"f{i}", f"u{rng.randrange(40)}", rng.randrange(20) / 20) for i in range(60) for _ in range(4)]
    pairs = list({(f, u): (f, u, c) for f, u, c in pairs}.values())
    got = {(r["file_path"], r["uri"]) for r in linkage.assign_one_to_one(spark.createDataFrame(pairs, "file_path string, uri string, confidence double"), rest).collect()}
    assert got == greedy(pairs)


def test_assignment_of_files_that_rank_alike_takes_few_rounds(spark):
    pairs = [(f"f{i:02}", f"u{j:02}", 1.0) for i in range(20) for j in range(20)]
    with tables_made() as made:
        got = {(r["file_path"], r["uri"]) for r in linkage.assign_one_to_one(spark.createDataFrame(pairs, "file_path string, uri string, confidence double"), 100).collect()}
    assert got == greedy(pairs)
    # 400 pairs, 100 or more settled in each round; by mutually best pairs alone there were 10.
    assert sum("taken-pairs" in df.inputFiles()[0] for df in made if df.inputFiles()) <= 3


def test_survivors_of_groups_with_one_short_id(spark):
    rows = [("same", "a1", "a1", True), ("same", "a1", "a2", False), ("same", "b1", "b1", False), ("same", "b1", "b2", True), ("own", "c1", "c1", True), ("own", "c1", "c2", False)]
    groups = spark.createDataFrame(rows, "group_id string, leader string, uri string, primary boolean")
    found = {r["uri"]: r["survivor"] for r in duplicates.survivors(groups).collect()}
    assert found == {"a1": "a1", "a2": "a1", "b1": "b2", "b2": "b2", "c1": "c1", "c2": "c1"}
    chosen = spark.createDataFrame([("same", "b1"), ("own", "x")], "group_id string, uri string")
    found = {r["uri"]: r["survivor"] for r in duplicates.survivors(groups, chosen).collect()}
    assert found == {"a1": "a1", "a2": "a1", "b1": "b1", "b2": "b1", "c1": "c1", "c2": "c1"}


@settings(max_examples=200, deadline=None)
@given(st.text("abc ", max_size=40), st.text("abc ", max_size=40))
def test_matching_blocks(a, b_):
    assert similarity.matched(a, b_) == sum(m.size for m in difflib.SequenceMatcher(None, a, b_, autojunk=False).get_matching_blocks())


def test_contained_pairs(spark):
    rng = random.Random(1)
    texts = {"".join(rng.choices("abc%_ ", k=rng.randrange(12))) for _ in range(150)}
    needles = {"".join(rng.choices("abc%_ ", k=rng.randrange(6))) for _ in range(60)}
    got = postings.contained(spark.createDataFrame([(n,) for n in needles], "needle string"), spark.createDataFrame([(t,) for t in texts], "text string"))
    assert rows(got) == sorted(((n, t) for n in needles if n for t in texts if n in t), key=str)


def test_files_of_names(spark):
    inventory = spark.createDataFrame([("/m/A - Song.mp3",), ("/m/b_ the tune!.mp3",), ("/m/Zed - Long Melodie 7.mp3",), ("/n/Song by q.mp3",)], "file_path string")
    wanted = spark.createDataFrame([("Song", "A, B"), ("The Tune", "B"), ("Long Melody", "Zed"), ("Nothing", "Nobody")], "title string, artists string")
    got = {r["title"]: (r["file_path"], r["rule"]) for r in linkage.find_files(wanted, inventory).collect()}
    assert got == {"Song": ("/m/A - Song.mp3", "contains"), "The Tune": ("/m/b_ the tune!.mp3", "contains"), "Long Melody": ("/m/Zed - Long Melodie 7.mp3", "fuzzy")}
    other = spark.createDataFrame([("It's", "Ann")], "title string, artists string")
    dotted = spark.createDataFrame([("/m/ann. its.mp3",)], "file_path string")
    assert [r["rule"] for r in linkage.find_files(other, dotted).collect()] == ["cleaned"]
    exist = {r["title"]: r["found"] for r in linkage.files_exist(wanted, inventory).collect()}
    squeezed = lambda x: re.sub(r'[\s()\\/*?:"<>|]', "", x).lower()
    names = [squeezed(p.rsplit("/", 1)[1][:-4]) for (p,) in inventory.collect()]
    ratio = lambda a, b_: 2 * similarity.lcs_length(a, b_) / (len(a) + len(b_))
    assert exist == {t: any(ratio(squeezed(a + t), n) >= 0.5 for n in names) for t, a in map(tuple, wanted.collect())}


def test_duplicate_leaders_and_manual_groups(spark):
    t = [
        ("u1", "i1", "Song (Explicit)", "A, B", "x", 100, False), ("u2", "i2", "song", "b,A", "long album", 100, False), ("u3", None, "Song", "A, B", "x", 200, True),
        ("u4", "i4", "Other", "A", "x", 50, False), ("u5", "i5", "other", "a", "x", 50, False), ("u6", "i6", "Alone", "A", "", 1, False),
    ]
    df = spark.createDataFrame(t, "uri string, track_id string, title string, artists string, album string, duration_ms long, is_local boolean")
    got = duplicates.duplicate_groups(df).collect()
    first = {r["uri"]: r["primary"] for r in got}
    # "b,A" has another block than "A, B", so u2 stands alone.
    assert first == {"u1": False, "u3": True, "u4": True, "u5": False}
    assert {r["uri"]: r["manual"] for r in got}["u4"]


def test_near_equal_forms_join_the_first_leader(spark):
    # Bracketed text and punctuation don't count for blocks; forms compare with them.
    long = "a rather long title that goes on"
    t = [(f"u{k}", x, "Somebody Else", 100 + k) for k, x in enumerate([f"{long}!", f"{long}?", f"{long} (live at the old place)", long.upper(), "other (a)", "other (b, which is far longer)"])]
    df = spark.createDataFrame([(u, None, x, a, "", d, False) for u, x, a, d in t], "uri string, track_id string, title string, artists string, album string, duration_ms long, is_local boolean")
    got = {r["uri"]: (r["leader"], r["primary"]) for r in duplicates.duplicate_groups(df).collect()}
    assert got == {"u0": ("u0", False), "u1": ("u0", False), "u3": ("u0", True)}


def test_playlists_parse_odd_lines(spark):
    text = "#EXTM3U\r\n#EXTINF:12.7,A - B\r\nx.mp3\n\n# note\ny.mp3\n#EXTINF:bad,only\nz.mp3\n#EXTINF:1,no path\n"
    got = playlists.parse_m3u(spark.createDataFrame([("f", text), ("e", "")], "file string, content string"))
    assert rows(got) == [("f", 1, 12, "A - B", "A", "B", "x.mp3"), ("f", 2, 0, "", "", "", "y.mp3"), ("f", 3, 0, "only", "", "only", "z.mp3")]


def test_exclusions(spark):
    df = spark.createDataFrame([("1", "My DJ set", None), ("2", "Radio", "the set list"), ("3", "x", "reset"), ("4", "x", None)], "id string, name string, about string")
    out = catalog.excluded(F.col("name"), F.col("id"), F.col("about"), ["dj"], ["Nope"], ["4"], ["Set"])
    assert [r["id"] for r in df.where(~out).collect()] == ["3"]


def test_feeds(spark, tmp_path):
    item = lambda **k: {"added_at": "2024-01-01T00:00:00Z", "track": {"artists": [{"name": "A"}, {"name": ""}, {"name": "B"}], "album": {"name": ""}, "duration_ms": 0, **k}}
    page = {"playlist_id": "p", "items": [item(id="1", uri="u:t:1", name="N", is_local=False), {"added_at": None, "track": None}, item(id=None, uri="", name="L", is_local=True)]}
    (tmp_path / "t.json").write_text(json.dumps(page))
    pages = feeds.read_pages(spark, str(tmp_path / "t.json"), feeds.TRACK_PAGE)
    got = feeds.tracks(pages).orderBy("pos").collect()
    assert [(r["uri"], r["track_id"], r["artists"], r["album"], r["duration_ms"]) for r in got] == [("u:t:1", "1", "A, B", "", None), (None, None, "A, B", "Local File", None)]
    assert rows(feeds.members(pages)) == [("p", "u:t:1")]
    assert [r["key"][:6] for r in feeds.legacy_members(pages).orderBy("key").collect()] == ["1", "local_"]
    lists = {"items": [{"id": "a", "name": " X ", "owner": {"id": "me"}}, {"id": "b", "name": "Y", "owner": {"id": "you"}}]}
    (tmp_path / "p.json").write_text(json.dumps(lists))
    found = feeds.playlists(feeds.read_pages(spark, str(tmp_path / "p.json"), feeds.PLAYLIST_PAGE), "me")
    assert rows(found.select("playlist_id", "name", "snapshot_id")) == [("a", "X", "")]


def test_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.MP3").write_bytes(b"abc")
    (tmp_path / "in/b.txt").write_text("x\n\n y \n")
    (tmp_path / "in/u.m3u").write_bytes("é.mp3".encode())
    (tmp_path / "in/l.M3U").write_bytes("é.mp3".encode("latin-1"))
    root = str(tmp_path / "in")
    assert [(r["ext"], r["size"]) for r in files.inventory(spark, root).collect()] == [("mp3", 3)]
    assert {r["name"]: r["content"] for r in files.playlist_texts(spark, root).collect()} == {"u": "é.mp3", "l": "é.mp3"}
    assert rows(files.keys(spark, f"{root}/b.txt")) == [("x",), ("y",)]
    assert files.latest(spark, root, "b.txt").first()["file"].endswith("b.txt")
    assert {len(r["quick"]) for r in files.fingerprints(spark, root).collect()} == {32}
    (tmp_path / "c.json").write_text('{\n"forbidden_words": ["x"]}')
    assert files.exclusion_config(spark, str(tmp_path / "c.json")) == {"words": ["x"], "names": [], "keys": [], "keywords": []}


def test_only_changed_files_are_read_again(spark, tmp_path):
    root, sha = tmp_path / "music", lambda x: hashlib.sha256(x).hexdigest()
    (root / "a [live] {1}").mkdir(parents=True)
    one, two, three = root / "a [live] {1}/x*?.mp3", root / "ü – é.MP3", root / "gone.flac"
    for p in (one, two, three):
        p.write_bytes(p.name.encode())
    (root / "note.txt").write_text("no audio")
    known = files.refreshed(spark, str(root))
    assert sorted(r["full"] for r in known.collect()) == sorted(sha(p.name.encode()) for p in (one, two, three)) and all(r["was_read"] for r in known.collect())
    known.write.parquet(f"{tmp_path}/known")
    three.unlink()
    two.write_bytes(b"other")
    (root / "new.wav").write_bytes(b"new")
    again = files.refreshed(spark, str(root), spark.read.parquet(f"{tmp_path}/known"))
    assert sorted((r["full"], r["was_read"]) for r in again.collect()) == sorted([(sha(one.name.encode()), False), (sha(b"other"), True), (sha(b"new"), True)])
    again.write.parquet(f"{tmp_path}/known2")
    assert not any(r["was_read"] for r in files.refreshed(spark, str(root), spark.read.parquet(f"{tmp_path}/known2")).collect())
    (tmp_path / "none").mkdir()
    assert files.refreshed(spark, str(tmp_path / "none")).count() == 0


def test_exports(spark, tmp_path):
    texts = spark.createDataFrame([("p1", "#EXTM3U\na"), ("p2", "#EXTM3U\nb")], "playlist_id string, content string")
    exports.write_playlists(texts, f"{tmp_path}/m3u")
    back = spark.read.text(f"{tmp_path}/m3u", wholetext=True)
    assert rows(back.select("playlist_id", F.trim(F.regexp_replace("value", "\n$", "")))) == [("p1", "#EXTM3U\na"), ("p2", "#EXTM3U\nb")]
    rows_ = spark.createDataFrame([(1, "T", "A", "MP3 File", 9, "file://x", 51, "low")], "track_no int, title string, artist string, kind string, duration int, location string, stars int, energy string")
    exports.write_collection(rows_, f"{tmp_path}/xml")
    assert spark.read.format("xml").option("rowTag", "TRACK").load(f"{tmp_path}/xml").first()["_Name"] == "T"
    exports.write_report(rows_, f"{tmp_path}/csv")


def test_versions(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    versions.write_version(df, str(tmp_path), 1)
    old = versions.read_version(spark, str(tmp_path), 1, "k string, v int")
    new = versions.insert_new(old, spark.createDataFrame([("b", 9), ("c", 3), ("c", 3)], "k string, v int"), ["k"])
    versions.write_version(new, str(tmp_path), 2)
    assert rows(versions.read_version(spark, str(tmp_path), 2, "k string, v int")) == [("a", 1), ("b", 2), ("c", 3)]
    assert versions.emptied(old).count() == 0
    with pytest.raises(Exception):
        versions.write_version(new, str(tmp_path), 2)


def test_many_small_files_are_written_by_the_tasks_and_replaced_whole(spark, tmp_path):
    root = str(tmp_path / "music")
    rows = spark.createDataFrame([(k, f"first {k}", n) for k in range(50) for n in (2, 1)], "key long, line string, n int")
    queries_sources._text_files(rows, f"file://{root}", "mp3", order="n")
    queries_sources._text_files(rows.where("key < 3 and n = 1").withColumn("line", F.lit("é")), f"file://{root}", "mp3", "ISO-8859-1", mode="overwrite")
    found = {str(p.relative_to(root)): p.read_bytes() for p in (tmp_path / "music").rglob("*") if p.is_file()}
    assert found == {f"key={k}/lines.mp3": b"\xe9\n" if k < 3 else f"first {k}\nfirst {k}\n".encode() for k in range(50)}


@pytest.fixture
def a_task_for_each_file(spark):
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, "1b")
    yield
    spark.conf.set(name, before)


def test_scans_of_many_small_files_take_few_tasks(spark, tmp_path, a_task_for_each_file):
    for k in range(60):
        (tmp_path / f"{k}.m3u").write_text(f"{k}.mp3\n")
        (tmp_path / f"{k}.MP3").write_text(str(k))
        (tmp_path / f"{k}.txt").write_text("no audio")
    texts, known = files.playlist_texts(spark, str(tmp_path)), files.refreshed(spark, str(tmp_path))
    assert texts.count() == known.count() == 60
    assert max(df.rdd.getNumPartitions() for df in (texts, known)) <= 16


def test_a_stream_of_many_small_files_takes_few_tasks(spark, tmp_path, a_task_for_each_file):
    (tmp_path / "in").mkdir()
    for k in range(60):
        (tmp_path / "in" / f"{k}.m3u").write_text(f"{k}.mp3\n")
    out = queries_sources._streamed(files.playlist_texts(spark, str(tmp_path / "in"), stream=True), str(tmp_path))
    assert out.count() == 60
    assert len(list((tmp_path / "out").rglob("part-*.parquet"))) <= 16


def test_pages_of_feeds_are_kept_compressed(spark, tmp_path):
    queries_files._write_pages(queries_files._track_page_rows(spark, SF), str(tmp_path / "pages"))
    back = feeds.read_pages(spark, str(tmp_path / "pages"), feeds.TRACK_PAGE)
    plain = back.agg(F.sum(F.length(F.to_json(F.struct("*"))))).first()[0]
    kept = list((tmp_path / "pages").glob("part-*"))
    assert kept and 4 * sum(p.stat().st_size for p in kept) < plain
    assert feeds.tracks(back).count() == b.pairs(spark, SF).join(b.tracks(spark, SF), "uri").count()
