"""Cases in which an operator once did less than its whole job."""

import hashlib
import os
import random
import re

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from concordat.llm import bpe, classifier, fingerprint, langid, lines, minhash, mixing, order, pieces, private, rules, stage, text, token_files
from concordat.llm import queries as q
from concordat.llm.queries import vocabulary

from . import cases
from .test_operators import SF, components_by_force, shingles_of


def texts_by(frame, *keys):
    return sorted(tuple(r[k] for k in keys) for r in frame.collect())


def test_lines_of_rows_without_an_own_id(spark):
    passage = "p\nq\nr"
    rows = [
        (None, f"a1\na2\na3\n{passage}"),
        (None, f"b1\nb2\nb3\n{passage}"),  # the same passage at the same place
        (None, "c1\nc2\nc3\nc4\nc5\nc6"),  # lines of its own at that place
        (7, f"d1\nd2\nd3\n{passage}"),
        (7, "e1\ne2\ne3\ne4\ne5\ne6"),
    ]
    got = [r["text"] for r in lines.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sum(passage in t for t in got) == 1
    assert all("\n".join(f"{c}{k}" for k in (1, 2, 3)) in "\n".join(got) for c in "abcde")
    assert rows[2][1] in got and rows[4][1] in got


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(name, n=40):
    return " ".join(f"{name}{k}" for k in range(n))


def test_pipeline_stages_keep_rows_without_an_own_id(spark):
    near = prose("near", 60)
    rows = [(None, prose("a")), (None, prose("b")), (None, prose("b")), (None, near), (None, near + " more"), (4, prose("c")), (4, prose("c")), (4, prose("d")), (5, prose("b"))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA)
    got = corpus_pipeline.near_dedup(spark, docs, "").collect()
    texts = [r["text"] for r in got]
    assert sorted(t for t in texts if not t.startswith("near")) == sorted(prose(c) for c in "abcd")
    assert sum(t.startswith("near") for t in texts) == 1
    assert [r["doc_id"] for r in got if r["text"] == prose("b")] == [5]


def test_mixing_stage_keeps_null_ids(spark):
    rows = [(None, prose("a")), (None, prose("b")), (1, prose("c")), (1, prose("d"))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA)
    assert texts_by(corpus_pipeline.source_mix(spark, docs, ""), "text") == sorted((t,) for _, t in rows)


def test_classifier_stage_judges_each_row(spark, tmp_path):
    cases.labels(spark).write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame([(k, prose(f"good{k}"), "en", "s", 1) for k in (None, None, 3, 3)], SCHEMA)
    bad = lambda rows, labels, **kw: rows.select(*kw.get("keep", ()), "doc_id", F.lit(False).alias("held_out"), F.lit(0.1).alias("score"), F.lit(0).alias("predicted"))
    own, corpus_pipeline.classifier.quality_scores = corpus_pipeline.classifier.quality_scores, bad
    try:
        assert corpus_pipeline.quality_classifier(spark, docs, str(tmp_path)).count() == 0
    finally:
        corpus_pipeline.classifier.quality_scores = own
    scored = own(docs.withColumn("mark", F.lit("x")), cases.labels(spark), keep=("mark",)).collect()
    assert [r["mark"] for r in scored] == ["x"] * 4


def test_disclosing_terms_far_from_the_address_and_without_it(spark, monkeypatch):
    rng = random.Random(3)
    fill = lambda n: " ".join("".join(rng.choices("bcdfglmnrs", k=2)) + rng.choice("aeiou") for _ in range(n))
    rows = [(k, f"Zebulon {fill(5)} {fill(90)} write to zeb@example.org {fill(9)} zebulon") for k in range(8)]
    rows += [(50, f"{fill(9)} Zebulon {fill(9)}")]
    rows += [(k, f"{fill(9)} write to a{k}@example.org {fill(90)}") for k in range(100, 160)]
    rows += [(k, fill(9)) for k in range(200, 500)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for most in (private.BROADCAST, 0):
        monkeypatch.setattr(private, "BROADCAST", most)
        got = {r["doc_id"]: r["spans"] for r in private.private_spans(df).collect()}
        for k, text in rows[:9]:
            words = [text[int(s) : int(e)].lower() for kind, s, e in (x.split(":") for x in got[k].split(",") if x) if kind == "term"]
            assert words.count("zebulon") == (1 if k == 50 else 2)
    assert "zebulon" not in private.sanitise(df).where("doc_id = 50").first()["text"].lower()


def test_one_passage_is_one_context_far_from_the_address():
    found = private.matches
    text = "one two three four five six seven eight nine ten eleven twelve " + "a1 " * 90 + "x@example.org alpha"
    marks = {m for t, _, m, _ in (x for k in range(5) for x in private.together(f"{text} n{'abcde'[k]}z", found(text), {"email:x@example.org"})) if t == "one"}
    assert len(marks) == 1


def test_languages_of_long_texts_only(spark):
    rows = [(k, " ".join(f"{w}{'aeiou'[k % 5]}n" for w in words * 400), lang) for lang, words, ks in (("x", ["bad", "dag"], range(1, 20)), ("y", ["kor", "tol"], range(20, 40))) for k in ks]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert min(len(t) for _, t, _ in rows) > langid.LONGEST
    got = {r["doc_id"]: r["lang_pred"] for r in langid.languages(docs).collect()}
    assert got == {k: lang for k, _, lang in rows}


def test_many_letters_stay_distinct():
    rng = random.Random(7)
    texts = {}
    for k, lang in enumerate("pqrs"):
        letters = [chr(0x4E00 + 500 * k + i) for i in range(400)]
        texts[lang] = [" ".join("".join(rng.choices(letters, k=3)) for _ in range(100)) for _ in range(30)]
    parser = langid.Parser({lang: t[:20] for lang, t in texts.items()} | {"z": ["the quick brown fox jumps over the lazy dog " * 9]})
    for lang, t in texts.items():
        assert parser.predict(t[20:])[0] == [lang] * 10
    learned, text = texts["p"][0], texts["p"][1] + texts["q"][0] + "aß" + texts["p"][0][5:90]
    one = langid.Parser({"x": [learned]})
    n, at = 1, 0
    for k in range(len(text)):
        if text[at : k + 1] not in learned:
            n, at = n + 1, k if text[k] in learned else k + 1
    codes = langid.code_points(text)
    assert len(text) <= langid.STRETCH and one.phrases(codes, np.array([0, len(codes)]))[0, 0] == n


def thue_morse(n, swap):
    return "".join("ab"[(k.bit_count() + swap) % 2] for k in range(n))


def test_pieces_of_one_hash_keep_their_own_ids(monkeypatch):
    texts = [thue_morse(n, swap) for n in (1024, 2048) for swap in (0, 1)] + ["one two six ten", "the cat", "12 345"]
    for module, file in ((bpe, "word_bpe_49k.json"), (token_files, "byte_bpe_50k.json")):
        library = Tokenizer.from_file(vocabulary(file))
        expected = [library.encode(t, add_special_tokens=False).ids for t in texts]
        assert [x.tolist() for x in module.load(vocabulary(file)).encode(texts)] == expected
        with monkeypatch.context() as m:  # every piece of one length has one hash
            m.setattr(pieces, "quick_hashes", lambda codes, starts, ends: (ends - starts).astype(np.uint64))
            module.load.cache_clear()
            assert [x.tolist() for x in module.load(vocabulary(file)).encode(texts)] == expected
            module.load.cache_clear()


def test_span_hashes_of_colliding_families_differ():
    for n in (1024, 2048):
        codes = langid.code_points(thue_morse(n, 0) + thue_morse(n, 1))
        for c in (codes, codes.astype(np.uint8)):
            one, two = text.span_hashes(c, np.array([0, n]), np.array([n, 2 * n]))
            assert one != two
    long = np.arange(1 << 13, dtype=np.uint32) % 977
    whole = text.span_hashes(long, np.array([977, 5, 9]), np.array([1977, 1005, 1009]))
    moved = text.span_hashes(long[5:2000], np.array([0, 4]), np.array([1000, 1004]))
    assert whole[1:].tolist() == moved.tolist() and whole[0] != whole[1]


def test_hashes_of_long_texts_are_those_of_their_stretches():
    rng = np.random.default_rng(5)
    codes = rng.integers(0, 200, 3 * text.STRETCH).astype(np.uint32)
    starts = np.sort(rng.integers(0, len(codes) - 10, 4000))
    ends = starts + rng.integers(1, 9, 4000)
    ends[7] = len(codes)  # one span over several stretches
    for hashes in (text.span_hashes, text.quick_hashes):
        for c in (codes, codes.astype(np.uint8)):
            assert (hashes(c, starts, ends) == hashes.__wrapped__(c, starts, ends)).all()


def test_row_sums_do_not_depend_on_neighbours():
    rng = np.random.default_rng(1)
    values = rng.normal(0, 1, 5000)
    bounds = np.array([0, 0, 1000, 1000, 3000, 5000])
    got = text.sums_by_row(values, bounds)
    assert got[0] == got[2] == 0
    assert [text.sums_by_row(values[a:b], np.array([0, b - a]))[0] for a, b in zip(bounds, bounds[1:])] == got.tolist()


def test_long_runs_of_digits_and_many_matches():
    zeros = "0" * 5000
    assert private.written(private.matches(f"{zeros}.1.1.1 x {zeros}255.0.0.1 9{zeros}.1.1.1")) == f"ip:0:5006,ip:5009:{5009 + 5009}"
    text = " ".join(f"a{k}@example.org near{'abcdefgh'[k % 8]}" for k in range(20_000))
    found = private.protected(text)
    assert len(found) == 20_000 and sum(1 for _ in private.together(text, found, {"email:a5@example.org"})) == 8


def test_secrets_are_spans_of_their_own_kind(spark):
    value = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"
    rows = [(1, f'x token = "{value}" y'), (2, "the token: something password = required, key=abc12345"), (3, "API_KEY:'k3y-k3y-k3y' tokens = 12 at 1.2.3.4"), (None, None)]
    got = {r["doc_id"]: r for r in private.private_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1]["spans"] == f"secret:11:{11 + len(value)}" and got[1]["n_secret"] == 1
    assert got[2]["spans"] == "" and got[None]["spans"] == ""
    assert got[3]["spans"] == "secret:9:20,ip:37:44" and (got[3]["n_secret"], got[3]["n_ip"], got[3]["n_term"]) == (1, 1, 0)
    clean = private.sanitise(spark.createDataFrame(rows + [(1, "plain")], "doc_id long, text string")).collect()
    assert sorted(str(r["text"]) for r in clean) == sorted(['x token = "[secret]" y', "plain", rows[1][1], "API_KEY:'[secret]' tokens = 12 at [ip]", "None"])


def test_disclosure_by_force(spark):
    """Terms, entities and their information counted plainly over all documents."""
    rng = random.Random(12)
    words = [a + b + c for a in "bdgkl" for b in "aeiou" for c in ("mor", "tan", "vel", "xis")]
    rows = []
    for k in range(120):
        own = rng.sample(words, 6)
        if k % 6 == 0:
            own.insert(rng.randrange(6), "quorthan")
            own.insert(rng.randrange(6), "mail q@example.org now")
        if k % 6 == 1:
            own.insert(3, f"mail r{k % 4}@example.org now")
        rows.append((k, " ".join(own)))
    terms = {k: {m.lower() for m in re.findall(r"[^\W\d_]{3,}", re.sub(r"\S+@\S+", " ", t))} for k, t in rows}
    names = {k: set(re.findall(r"\S+@\S+", t)) for k, t in rows}
    telling = set()
    for name in {n for x in names.values() for n in x}:
        own = [k for k in names if name in names[k]]
        for term in {t for k in own for t in terms[k]}:
            both = [k for k in own if term in terms[k]]
            n_term = sum(term in x for x in terms.values())
            informs, whole = np.log2(len(both) * len(rows) / (n_term * len(own))), np.log2(len(rows) / len(own))
            if len(both) >= private.CONTEXTS and informs >= private.DISCLOSED * whole:
                telling.add(term)
    assert "quorthan" in telling and "mail" not in telling
    for r in private.private_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        t = rows[r["doc_id"]][1]
        marked = {t[int(a) : int(b)] for kind, a, b in (x.split(":") for x in r["spans"].split(",") if x) if kind == "term"}
        assert marked == terms[r["doc_id"]] & telling


def test_ranges_split_an_id_that_many_rows_have(spark):
    rng = np.random.default_rng(3)
    ids = np.concatenate([np.full(5000, order.LOWEST), np.full(3000, 40), rng.integers(0, 100, 2000)])
    h = rng.integers(-(1 << 63), (1 << 63) - 1, len(ids))
    docs = spark.createDataFrame([(None if i == order.LOWEST else int(i),) for i in ids.tolist()], "doc_id long")
    found = order.ranges(docs, "doc_id", 8)
    part = found.of(ids, h)
    ranked = np.lexsort((h, ids))
    assert (np.diff(part[ranked]) >= 0).all() and part.max() < found.count
    assert np.bincount(part).max() < 3 * len(ids) / found.count


def test_likeness_by_force():
    """The common extensions between marks, found by comparing the texts themselves."""
    rng = random.Random(8)
    block = lambda: "".join(rng.choices("abcdefgh ", k=32))
    for _ in range(20):
        a = [block() for _ in range(40)]
        b = a[10:25] + [block() for _ in range(15)] + a[30:40]
        one, two = ("".join(x) for x in (a, b))
        f, g = (fingerprint.Fingerprint.of(fingerprint.code_points(t)) for t in (one, two))
        i = total = 0
        while i < len(a):
            best = 0
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                    n += 1
                best = max(best, n)
            total, i = total + best, i + max(1, best)
        assert total == 25
        assert fingerprint.shared_length(f.arrays(32), g.arrays(32)) == total
        assert f.likeness(g) >= 32 * total / len(one)
        assert f.likeness(f) == 1 and f.likeness(fingerprint.Fingerprint.of(fingerprint.code_points(""))) == 0
    off = []
    for k in range(1, 9):
        whole = "".join(block() for _ in range(9))
        one, two = "x" + whole, whole[: 32 * k] + block() * 3
        s, t = ({x[i : i + 16] for i in range(len(x) - 15)} for x in (one, two))
        f, g = (fingerprint.Fingerprint.of(fingerprint.code_points(x)) for x in (one, two))
        off.append(abs(f.likeness(g) - 2 * len(s & t) / (len(s) + len(t))))
    assert max(off) < 0.35 and sum(off) / len(off) < 0.12


def test_edits_of_rows_without_an_own_id(spark):
    rows = [(None, "b" * 40), (None, "a" * 40), (3, "c" * 40), (3, "d" * 40), (9, ""), (9, None), (12, "e" * 40)]
    got = fingerprint.fingerprint_edits(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(i) for i, _ in rows)
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    firsts = {digest("e" * 30 + x * 10) for x in "ab"}
    assert [r["edited_sha256"] for r in got if r["doc_id"] == 12][0] in firsts
    assert {r["edited_sha256"] for r in got if r["doc_id"] == 9} == {digest("")}
    assert sum(r["edited_sha256"] in {digest("a" * 30 + "b" * 10), digest("b" * 30 + "a" * 10)} for r in got) == 1


def test_token_files_lie_in_the_order_of_ids(spark, tmp_path):
    rows = [(k * 7 % 1000, f"text number {k}") for k in range(1000)] + [(None, "none"), (None, "null"), (5, "again")]
    to = f"file://{tmp_path}/tokens"
    token_files.write_files(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), vocabulary("byte_bpe_50k.json"), to, 2)
    seen = [i for f in sorted((tmp_path / "tokens/blocks").glob("*.parquet")) for r in pq.read_table(f).to_pylist() for i in r["doc_ids"]]
    assert len(seen) == len(rows) and seen == [None, None, *sorted(i for i, _ in rows if i is not None)]
    back = token_files.read_files(spark, to).orderBy("start").collect()
    at = 0
    for r in back:
        assert (r["start"], len(r["ids"])) == (at, r["n_tokens"])
        at += r["n_tokens"]
    with pytest.raises(ValueError):
        token_files._planes(np.array([1 << 24]))


def test_lines_of_a_long_text(spark):
    """Repeats, blank lines and overlapping windows in one text of many lines, against the rule applied plainly."""
    rng = random.Random(2)
    drawn = [rng.choice(["", " "] + [f"l{k}" for k in range(9)]) for _ in range(3000)] + [f"own {k % 20000}" for k in range(40_000)]
    rows = [(1, "\n".join(drawn)), (2, "\n".join(drawn[100:140])), (3, None), (4, "")]
    seen, expected = set(), {}
    for i, t in rows[:2]:
        all_ = t.split("\n")
        solid = [k for k, x in enumerate(all_) if x.strip()]
        gone = set()
        for p in range(len(solid) - 2):
            w = tuple(all_[k].strip() for k in solid[p : p + 3])
            if w in seen:
                gone |= set(solid[p : p + 3])
            seen.add(w)
        expected[i] = (len(all_), len(gone), "\n".join(x for k, x in enumerate(all_) if k not in gone))
    expected |= {3: (0, 0, None), 4: (1, 0, "")}
    got = {r["doc_id"]: (r["n_lines"], r["n_removed"], r["text"]) for r in lines.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == expected


def test_buckets_of_more_members_than_a_block(spark):
    """A group of near copies beyond BLOCK_NODES, and alike texts in it that no link joins, against all pairs."""
    rng = random.Random(6)
    word = lambda: f"w{rng.randrange(10**6)}"
    base, far = [word() for _ in range(60)], [word() for _ in range(100)]
    rows = []
    for k in range(600):
        t = list(base)
        t[rng.randrange(60)] = word()
        rows.append((k, " ".join(t)))
    for k in range(600, 900):  # two thirds in common: they meet in buckets, and few are linked
        t = list(far)
        for _ in range(rng.choice([3, 9, 12])):
            t[rng.randrange(100)] = word()
        rows.append((k, " ".join(t)))
    rng.shuffle(rows)
    expected, _ = components_by_force([t for _, t in rows], [i for i, _ in rows], 2, 80)
    assert len(set(expected)) > 20
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2, 80).collect()}
    assert got == {i: c for (i, _), c in zip(rows, expected)}


def test_every_link_of_the_query_set_is_found(spark):
    """Recall of links between ids divisible by 20 and all rows, on the middle tables."""
    sf = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: r["text"] for r in q.documents(spark, sf).collect()}
    got = {r["doc_id"]: r["component_id"] for r in q.op4_near_duplicates(spark, sf).collect()}
    sets = {i: shingles_of(t, 2) for i, t in texts.items()}
    links = 0
    for i in (x for x in texts if x % 20 == 0):
        for j, own in sets.items():
            both = len(sets[i] & own)
            if i != j and both and 100 * both >= 80 * (len(sets[i]) + len(own) - both):
                links += 1
                assert got[i] == got[j]
    assert links > 5


def test_quality_verdict_by_force(spark):
    """The ratio of hashed n-grams, its threshold and the verdict, computed plainly."""
    docs = q.documents(spark, SF)
    held = {r["doc_id"]: r["k"] == 0 for r in docs.select("doc_id", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(2)).alias("k")).collect()}
    good = {r["doc_id"] for r in q.labels(spark, SF).where("quality = 1").collect()}
    got = {r["doc_id"]: r for r in rules.quality_rules(docs, q.labels(spark, SF)).collect()}

    def hashed(t):
        raw = np.frombuffer((t or "").encode(), np.uint8)
        tokens = [m.span() for m in re.finditer(rb"[0-9A-Za-z\x80-\xff]+|[!-/:-@\[-`{-~\x00-\x08\x0e-\x1f\x7f]+", raw.tobytes())]
        own = [int(text.span_hashes(raw, np.array([a]), np.array([b]))[0]) for a, b in tokens]
        pairs = [int(text.pair_hashes(np.array([a], np.uint64), np.array([b], np.uint64))[0]) for a, b in zip(own, own[1:])]
        return [x % rules.BUCKETS for x in own + pairs]

    found = {r["doc_id"]: hashed(r["text"]) for r in docs.collect()}
    raw, trusted = np.zeros(rules.BUCKETS), np.zeros(rules.BUCKETS)
    for i, x in found.items():
        np.add.at(raw, x, 1)
        if i in good and held[i]:
            np.add.at(trusted, x, 1)
    p = (raw + 1) / (raw.sum() + rules.BUCKETS)
    ratio = np.log((trusted + rules.BUCKETS * p) / (trusted.sum() + rules.BUCKETS) / p)
    llr = {i: float(np.mean(ratio[x])) if x else 0.0 for i, x in found.items()}
    assert all(abs(got[i]["llr"] - v) < 1e-9 for i, v in llr.items())
    known = sorted(got[i]["llr"] for i in got if i in good and not held[i] and not got[i]["base_failed"])
    cut = np.quantile(known, rules.LOSS)
    assert abs(got[0]["threshold"] - cut) < 1e-12
    assert all(r["kept"] == (not r["base_failed"] and r["llr"] >= r["threshold"]) for r in got.values())


def test_every_trusted_row_has_a_part_in_the_verdict(spark):
    """More trusted rows than a bounded draw took: counts and threshold of all of them."""
    texts = [" ".join(f"w{(k * k + j * j * 31) % 4001}" for j in range(10 + k % 5)) for k in range(26_000)]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(None, texts[0])] * 3, "doc_id long, text string").repartition(6)
    labels = spark.createDataFrame([(k, int(k % 10 > 0)) for k in range(26_000)], "doc_id long, quality int")
    held = np.array([r["k"] == 0 for r in labels.orderBy("doc_id").select(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(2)).alias("k")).collect()])
    good = np.arange(26_000) % 10 > 0
    raw = [t.encode() for t in texts + texts[:1] * 3]
    found, bounds = rules.ngrams(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]))
    row = text.rows_of(bounds)
    chosen = np.append(good & held, [False] * 3)[row]
    ratio = rules.log_ratio(np.bincount(found, minlength=rules.BUCKETS), np.bincount(found[chosen], minlength=rules.BUCKETS))
    llr = np.bincount(row, ratio[found]) / np.diff(bounds)
    cut = np.quantile(llr[:26_000][good & ~held], rules.LOSS)
    got = rules.quality_rules(docs, labels).collect()
    assert len(got) == 26_003 and all(abs(r["threshold"] - cut) < 1e-12 for r in got)
    assert all(abs(r["llr"] - llr[r["doc_id"] or 0]) < 1e-9 for r in got)
    assert all(r["kept"] == (r["llr"] >= r["threshold"]) for r in got) and {r["kept"] for r in got} == {True, False}


def test_quantile_of_values_of_any_spread(spark):
    rng = np.random.default_rng(8)
    lists = [[], [3.5], [2.0] * 50, [-1.0, 4.0], [0.0, -0.0, 1e-300, 1e-305], rng.normal(size=3_000).round(2).tolist()]
    lists += [(1 + rng.random(2_000) * 1e-13).tolist() + [-1e9, 1e9], (-(10.0 ** -rng.integers(0, 200, 500))).tolist()]
    for values in lists:
        df = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double").repartition(3)
        for share in (0.002, 0.5, 1.0):
            got = rules.quantile(df, share)
            assert got is None if not values else np.isclose(got, np.quantile(values, share), rtol=1e-12, atol=0.0), (values[:5], share)


def test_classifier_by_force(spark):
    """Context sums, pooled features and the network's forward pass, computed word by word."""
    docs = q.documents(spark, SF)
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    places, signs = classifier.index_vectors()
    words = {}
    for i, t in rows.items():
        raw = np.frombuffer((t or "").encode(), np.uint8)
        words[i] = classifier.hashed_words(raw, np.array([0, len(raw)]))[0].tolist()
    sums = np.zeros((classifier.WORDS, classifier.DIMS))
    for own in words.values():
        for k, w in enumerate(own):
            for j in range(max(0, k - classifier.REACH), min(len(own), k + classifier.REACH + 1)):
                if j != k:
                    np.add.at(sums[w], places[own[j]], signs[own[j]])
    assert (classifier.context_vectors(docs) == sums).all()
    vectors = classifier.word_vectors(sums)
    got = {r["doc_id"]: np.frombuffer(r["features"], np.float32) for r in classifier.pooled(docs, vectors).collect()}
    for i in list(rows)[:60]:
        x = vectors[words[i]].astype(float)
        beside = (x[1:] * x[:-1]).sum(1).mean() if len(x) > 1 else 0.0
        expected = [*x.mean(0), *x.std(0), beside, np.linalg.norm(x.mean(0)), np.log1p(len(x))] if len(x) else [0.0] * classifier.FEATURES
        assert np.allclose(got[i], expected, atol=2e-4)
    x = np.stack(list(got.values())).astype(float)
    net = classifier.Network(x, (x[:, 0] > np.median(x[:, 0])).astype(float), rounds=30)
    z = (x[5] - net.centre) / net.spread
    h = [np.tanh(sum(z[i] * net.w[0][i, j] for i in range(len(z))) + net.w[1][j]) for j in range(classifier.HIDDEN)]
    logit = sum(a * b for a, b in zip(h, net.w[2])) + net.w[3][0]
    assert abs(net.probabilities(x)[5] - 1 / (1 + np.exp(-logit / net.temperature))) < 1e-9


def test_intermediate_tables_are_deleted(spark):
    root = stage.shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(root))
    docs = q.documents(spark, SF)
    for name, run in (("op4", lambda: minhash.near_duplicates(docs, 2)), ("op10", lambda: token_files.round_trip(docs, vocabulary("byte_bpe_50k.json"))), ("op8", lambda: mixing.mix_sources(docs))):
        assert run().count() == docs.count()
        left = {x.rsplit("-", 1)[0] for x in set(os.listdir(root)) - before}
        assert not left & {"shared-keys", "sets", "links", "open-keys", "open-profiles", "clusters", "tokens", "cells"}, name


def test_tables_are_written_in_short_batches(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"

    def sizes(batches):
        for batch in batches:
            yield batch.select([0]).set_column(0, "id", np.full(len(batch), len(batch)))

    rows = spark.range(0, 5_000, 1, 1)
    for own in (None, "7", "20000", "0"):
        if own:
            spark.conf.set(name, own)
        most = stage.table(rows.mapInArrow(sizes, "id long"), "sizes").agg(F.max("id")).first()[0]
        assert most == (7 if own == "7" else stage.BATCH_ROWS) and spark.conf.get(name, None) == own
        spark.conf.unset(name)


def test_next_texts_of_rows_that_many_repeat(spark):
    """Repeated heads of ranges: each row's next text is the one behind it in the order."""
    rows = [(None, "n" * 40)] * 30 + [(5, "s" * 40)] * 30 + [(k, f"{k}" * 20) for k in range(6, 60)]
    got = fingerprint.fingerprint_edits(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    after = [t for _, t in rows[1:]] + [rows[0][1]]
    edited = [t[: len(t) - len(t) // 4] + n[: len(t) // 4] for (_, t), n in zip(rows, after)]
    want = sorted((str(i), hashlib.sha256(e.encode()).hexdigest()) for (i, _), e in zip(rows, edited))
    assert sorted((str(r["doc_id"]), r["edited_sha256"]) for r in got) == want


def test_counts_of_a_table_read_in_many_tasks(spark, tmp_path):
    texts = [(k, f"word{k % 7} and word{k % 11} in text {k}", "x") for k in range(400)]
    spark.createDataFrame(texts, "doc_id long, text string, more string").repartition(40).write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs").select("text", (F.col("doc_id") % 3 == 0).alias("trusted"))
    few = stage.fewer_tasks(docs, docs).rdd.getNumPartitions()
    raw, trusted = rules.ngram_counts(docs, docs)
    own = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "100")
        spark.conf.set("spark.sql.files.openCostInBytes", "100")
        many = stage.fewer_tasks(docs, docs).rdd.getNumPartitions()
        again = rules.ngram_counts(docs, docs)
    finally:
        for c, v in own.items():
            spark.conf.set(c, v)
    assert few <= 2 * int(spark.conf.get("spark.sql.shuffle.partitions")) < many
    assert (raw == again[0]).all() and (trusted == again[1]).all() and raw.sum() > trusted.sum() > 0
