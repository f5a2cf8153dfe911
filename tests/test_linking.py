"""Linking's arms and the ratio join against brute force."""

import random
import re

import pytest

from concordat import queries_linkage
from concordat.functions.similarity import lcs_length, lcs_lengths
from concordat.operators import linkage
from concordat.operators.similar import ratio_pairs

from .conftest import SF

TRACKS = "uri string, track_id string, title string, artists string, album string, duration_ms long, is_local boolean"


def ratio(a, b):
    return 2 * lcs_length(a, b) / (len(a) + len(b)) if a or b else 1.0


def strings(seed, n, letters="abcdeé 語🙂z-", longest=30):
    rng = random.Random(seed)
    out = {"", "a", "U2", "ab"} | {"".join(rng.choices(letters, k=rng.randint(0, longest))) for _ in range(n)}
    # Some are like others.
    for s in list(out)[: n // 2]:
        k = rng.randint(0, len(s))
        out.add(s[:k] + rng.choice(letters) + s[k + rng.randint(0, 2) :])
    return sorted(out)


def test_ratios_of_blocks_equal_those_of_pairs():
    a, b = strings(1, 900, longest=90), strings(2, 900, longest=140)
    both = [(x, y) for k, x in enumerate(a) for y in b[k % 7 :: 97]]
    assert lcs_lengths([x for x, _ in both], [y for _, y in both]).tolist() == [lcs_length(x, y) for x, y in both]
    assert lcs_length("abcbdab", "bdcaba") == 4


@pytest.mark.parametrize("least", [0.36, 0.5, 0.8, 1.0])
def test_ratio_pairs_lose_nothing(spark, monkeypatch, least):
    from concordat.operators import similar

    monkeypatch.setattr(similar, "SHARE", 100)
    a, b = strings(3, 250), strings(4, 250)
    left = spark.createDataFrame([(x,) for x in [*a, *a[:5], None]], "x string")
    right = spark.createDataFrame([(y,) for y in [*b, *a[:60], None]], "y string")
    pairs = ratio_pairs(left, right, "x", "y", least)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    got = {(r["x"], r["y"]): r["ratio"] for r in pairs.collect()}
    want = {(x, y): ratio(x, y) for x in a for y in {*b, *a[:60]} if ratio(x, y) >= least}
    assert got == pytest.approx(want)
    assert ratio_pairs(left.limit(0), right, "x", "y", least).count() == ratio_pairs(left, right.limit(0), "x", "y", least).count() == 0


def found(spark, files, tracks, mapped=(), threshold=0.6):
    f = spark.createDataFrame(files, "file_path string, duration_ms long")
    t = spark.createDataFrame([(u, None, title, artists, "", ms, local) for u, title, artists, ms, local in tracks], TRACKS)
    m = spark.createDataFrame([(u,) for u in mapped], "uri string")
    return {(r["file_path"], r["uri"]): (round(r["confidence"], 6), r["match_type"]) for r in linkage.candidates(f, t, m, threshold).collect()}


def test_local_tracks_by_name_stem_and_likeness(spark):
    tracks = [("l1", "Mix Tape", "", 1, True), ("l2", "song.mp3", "", 1, True), ("l3", "Song", "Other Band", 1, True), ("l4", "mix tapes", "", 1, True), ("l5", "MIX TAPE", "", 1, True)]
    files = [("/a/Mix Tape.mp3", 1), ("/a/song.mp3", 1), ("/a/Someone - Song.mp3", 1)]
    got = found(spark, files, tracks, mapped=["l5"])
    assert got[files[0][0], "l1"] == (1.0, "local_exact")
    assert got[files[0][0], "l5"] == (0.665, "local_normalised")
    assert got[files[0][0], "l4"] == (round(2 * 8 / 17, 6), "local_fuzzy")
    assert got[files[1][0], "l2"] == (1.0, "local_exact")
    # An unmapped track of the same stem has ratio 1, the surer of the two rules.
    assert got[files[1][0], "l3"] == (1.0, "local_fuzzy")
    # The title alone, after another artist, is no exact match.
    assert not [k for k in got if k[0] == files[2][0]]


def test_names_without_artist_misspelt_artists_and_two_notes(spark):
    tracks = [("r1", "Night Drive", "Red Moon", 100_000, False), ("r2", "Night Drive (Extended Mix)", "Red Moon, Guest", 100_000, False)]
    files = [("/Nigth Drive.mp3", 900_000), ("/Red Mon - Night Drive.mp3", 900_000), ("/Red Moon - Night Drive (Radio Edit).mp3", 900_000)]
    got = found(spark, files, tracks, threshold=0.3)
    like = ratio("nigth drive", "night drive")
    assert got[files[0][0], "r1"] == (round(like * 0.9, 6), "fuzzy")
    assert got[files[0][0], "r2"] == (round(like * 0.6 * 0.9, 6), "fuzzy")
    artist = ratio("red mon", "red moon")
    assert got[files[1][0], "r1"] == (round(artist * 0.6 + 0.4, 6), "fuzzy")
    note = max(ratio("radio edit", "extended mix"), 0)
    assert got[files[2][0], "r2"] == (round(0.6 + 0.4 * (0.7 + 0.3 * note), 6), "fuzzy")
    assert got[files[2][0], "r1"] == (round(0.6 + 0.4 * 0.6, 6), "fuzzy")


def test_names_without_artist_at_any_threshold(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    tracks = [(f"t{k:03}", f"{word()} {word()}", "x", None, False) for k in range(60)]
    files = [(f"/{word()} {rng.choice(tracks)[1][2:]}.mp3", None) for _ in range(20)]
    for threshold in (0.0, 0.3, 0.6):
        got = found(spark, files, tracks, threshold=threshold)
        want = {}
        for path, _ in files:
            scored = []
            for uri, title, *_ in tracks:
                r = ratio(path[1:-4], title)
                score = round(0.9 * (r if r >= 0.7 else r * 0.5), 9)
                if score >= max(threshold, 0.2):
                    scored.append((-score, uri))
            want |= {(path, u): (round(-s, 6), "fuzzy") for s, u in sorted(scored)[:8]}
        assert got == want


def test_existing_files_of_any_length(spark):
    wanted = spark.createDataFrame([("2", "U"), ("abcdef", ""), ("zz", "qq"), ("x", ""), ("", "")], "title string, artists string")
    files = spark.createDataFrame([("/U2.mp3",), ("/axbxcxdxexf.mp3",), ("/k.mp3",)], "file_path string")
    got = {(r["artists"], r["title"]): r["found"] for r in linkage.files_exist(wanted, files).collect()}
    assert got == {("U", "2"): True, ("", "abcdef"): True, ("qq", "zz"): False, ("", "x"): False, ("", ""): False}


def test_existing_files_by_force(spark):
    names = strings(9, 120, letters="abcdefghijk", longest=9)
    wanted, there = names[::2], names[1::2]
    files = spark.createDataFrame([(f"/{s}.mp3",) for s in there], "file_path string")
    for least in (0.5, 0.8):
        got = {r["title"]: r["found"] for r in linkage.files_exist(spark.createDataFrame([(s, "") for s in wanted], "title string, artists string"), files, least).collect()}
        assert got == {s: any(ratio(s.lower(), f.lower()) >= least for f in there) for s in wanted}


def test_files_like_a_name_without_a_common_word(spark):
    wanted = spark.createDataFrame([("Nothing Else Matters", "Metallica")], "title string, artists string")
    files = spark.createDataFrame([("/metalica - nothing else maters.mp3",), ("/other.mp3",)], "file_path string")
    (row,) = linkage.find_files(wanted, files).collect()
    assert (row["file_path"], row["rule"]) == ("/metalica - nothing else maters.mp3", "fuzzy")
    assert row["score"] == pytest.approx(ratio("metallica - nothing else matters", "metalica - nothing else maters"), abs=1e-6)


def test_what_grows_with_title_pairs_is_not_broadcast_by_the_size_of_its_files(spark):
    plan = queries_linkage.comp6_link_records(spark, SF)._jdf.queryExecution().executedPlan().toString()
    keys = set(re.findall(r"BroadcastHashJoin \[(\w+)#", plan))
    assert not keys & {"base", "artist", "low", "file_path", "track_title", "title"}, keys
