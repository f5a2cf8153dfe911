"""Operators 11 to 13 against brute force, on odd rows too."""

import hashlib
import re
from collections import Counter, defaultdict
from itertools import permutations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from concordat.llm import divergence, exact, interplay
from concordat.llm import queries as q

from ..conftest import SF
from . import cases

QUERIES = ("op11_source_divergence", "op12_filter_interplay", "op13_exact_duplicates")


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    expected = con.sql(q.oracle_sql()[name])
    got = q.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(expected.columns)
    names = sorted(got.columns)
    rows = lambda found: sorted(map(str, found))
    assert rows(tuple(r[c] for c in names) for r in got.collect()) == rows(expected.select(*names).fetchall())


# --- 11 ------------------------------------------------------------------------------------------------------

SCHEMA = "doc_id long, text string, lang string, source string"


def divergence_by_force(rows, least, top):
    ascii_lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(ascii_lower))
        groups.add((lang, source))
        counts[lang, source].update(found)
        docs[lang].update(set(found))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in docs[lang].items() if n >= least]
        own = sorted(s for x, s in groups if x == lang)

        def shares(c):
            size = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (size + 2 * len(kept)) for t in kept}

        p = {s: shares(counts[lang, s]) for s in own}
        total = sum((counts[lang, s] for s in own), Counter())
        whole = shares(total)
        far = lambda a, b: (a - b) ** 2 // (a + b)
        for s in own:
            pairs = sorted((-sum(far(p[s][t], p[o][t]) for t in kept), o.encode()) for o in own if o != s)
            out += [(lang, s, "pair", o.decode(), -v, k) for k, (v, o) in enumerate(pairs, 1)]
            terms = sorted((-far(p[s][t], whole[t]), t.encode()) for t in kept if counts[lang, s][t] and p[s][t] > whole[t])
            out += [(lang, s, "term", t.decode(), -v, k) for k, (v, t) in enumerate(terms[:top], 1)]
    return sorted(out)


def test_divergence_of_odd_rows(spark):
    rng = np.random.default_rng(5)
    words = ["a", "B", "Éa", "éA", "ß", "x-y", "Ünï", "語", "🙂", "zz9q", "\x00c", "d\x7fe"] + [f"w{chr(97 + k)}" for k in range(26)]
    rows = [(k, " ".join(rng.choice(words, size=rng.integers(0, 40))), rng.choice(["en", "de"]).item(), f"s{rng.integers(0, 5)}") for k in range(150)]
    rows += [(1, "same same", None, None), (1, "same same", None, ""), (None, None, "en", None), (None, "", "fr", "alone"), (3, " \n", "nn", "p"), (3, None, "nn", "q"), (4, "rare", "nn", "r")]
    rows += [(k, "tie " + w, "tt", "s") for k in range(3) for w in ("b", "a", "c")] + [(9, "other", "tt", "t")] * 3
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("term", "count", "value", "groups", "rank", "p"):
        df = df.withColumn(name, F.lit("clash"))
    for least, top in ((3, 10), (10, 2), (1, 1)):
        got = sorted(tuple(r) for r in divergence.divergence(df, least, top).collect())
        assert got == divergence_by_force(rows, least, top)


def test_divergence_of_a_very_long_text_and_of_none(spark):
    rows = [(k, "long " * 200_000 if k == 0 else "long short", "en", f"s{k % 2}") for k in range(12)]
    got = sorted(tuple(r) for r in divergence.divergence(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == divergence_by_force(rows, 10, 10)
    assert divergence.divergence(spark.createDataFrame([], SCHEMA)).count() == 0


def test_shares_beyond_a_long(spark):
    count, size, terms = 10**17, 3 * 10**17 + 1, 7
    one = spark.createDataFrame([(count, size, terms)], "c long, s long, t long")
    assert one.select(divergence._share("c", "s", "t")).first()[0] == 1 + 10**9 * (count + 2) // (size + 2 * terms)


# --- 12 ------------------------------------------------------------------------------------------------------


def interplay_by_force(rows, labels):
    good, toxic = {i for i, g, _ in labels if g == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    low = {}
    for i, text, *_ in rows:
        if i is not None:
            low[text or ""] = min(low.get(text or "", i), i)
    parts = defaultdict(list)
    for i, text, source in rows:
        text, words = text or "", re.findall(r"[^\x20\x09-\x0D]+", text or "")
        fails = {"A"} if len(words) < 200 else set()
        fails |= {"B"} if 100 * len(set(words)) < 50 * len(words) else set()
        fails |= {"C"} if 100 * len(re.findall("[A-Z]", text)) > 2 * len(text) else set()
        fails |= {"D"} if re.search(r"[#$%&*|]", text) else set()
        fails |= {"E"} if i is not None and i > low[text] else set()
        parts[source or ""].append((fails, i in good, i in toxic))
    out = []
    for part, docs in parts.items():
        total, found = Counter(), []
        for order in map("".join, permutations("ABCDE")):
            left = docs
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[0]]
                left = [d for d in left if f not in d[0]]
                total[f] += len(gone)
                fails = sum(f in d[0] for d in docs)
                found.append((part, order, step, len(left), len(gone), fails - len(gone), sum(d[0] == {f} for d in docs), sum(d[1] for d in gone), sum(d[2] for d in gone), f))
        out += [(*x[:-1], total[x[-1]]) for x in found]
    return sorted(out)


def test_interplay_of_odd_rows(spark):
    long_text = " ".join(f"word{k}" for k in range(250))
    rows = [(i, t, s) for i, t, _, s, _ in cases.rows()]
    rows += [(20, long_text, "a"), (21, long_text, "b"), (21, long_text, "b"), (None, long_text, "a"), (22, long_text + " #", "a"), (23, long_text.upper(), None), (24, "same " * 300, ""), (25, "same " * 300, "a")]
    labels = [(1, 1, 0), (1, 0, 1), (2, 1, 0), (21, 1, 1), (None, 1, 1), (25, None, 1), (24, 1, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for name in ("id", "part", "mask", "n", "digest", "good", "quality", "w"):
        df = df.withColumn(name, F.lit("clash"))
    got = interplay.filter_interplay(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert sorted(tuple(r) for r in got.collect()) == interplay_by_force(rows, labels)
    assert interplay.filter_interplay(df.limit(0), cases.labels(spark)).count() == 0


def test_potentials_give_shapley_values():
    counts = np.random.default_rng(2).integers(0, 1000, (3, 3, 32))
    got = interplay.steps(counts)
    _, bits, _ = interplay._orders()
    for k in range(5):
        at = bits == 1 << k
        assert (got["removed"][:, at].sum(axis=1) == got["shapley"][:, at][:, 0]).all()
    # The values of all filters share out what all five remove together.
    assert (got["shapley"][:, 0].sum(axis=1) == 120 * counts[:, 0, 1:].sum(axis=1)).all()


# --- 13 ------------------------------------------------------------------------------------------------------


def copies_by_force(rows):
    groups = defaultdict(list)
    for i, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", text or "")].append(i)
    out = []
    for text, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        sha = hashlib.sha256(text.encode()).hexdigest()
        out += [(i, keep, len(ids), sha) for i in ids]
    return sorted(map(str, out))


def odd_texts():
    rows = [(i, t) for i, t, *_ in cases.rows()]
    rows += [(30, "a b"), (29, "a\t\n b"), (31, " a b"), (32, "a b "), (33, "a\x0bb"), (34, "a b"), (35, "a b"), (None, "only"), (None, " only"), (None, "only")]
    return rows + [(100 + k % 40, f"text {k % 23} " * (k % 7)) for k in range(300)]


@pytest.mark.parametrize("held", [exact.HELD, 1_000])
def test_exact_duplicates_of_odd_rows(spark, held):
    rows = odd_texts()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("mark", F.lit("x")).withColumn("content", F.lit("clash")).withColumn("hash", F.lit("clash"))
    for n in (1, 5):
        got = exact.exact_duplicates(df.repartition(n), keep=("mark", "content", "hash"), held=held).collect()
        assert sorted(str((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"])) for r in got) == copies_by_force(rows)
        kept = Counter(r["text_sha256"] for r in got if r["kept"])
        assert kept == Counter({r["text_sha256"]: 1 for r in got})
        assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])
        assert {(r["mark"], r["content"]) for r in got} == {("x", "clash")}
    assert exact.exact_duplicates(df.limit(0)).count() == 0
    assert len(exact.without_copies(df).collect()) == len(kept)
    with pytest.raises(ValueError):
        exact.exact_duplicates(df.withColumn("kept", F.lit(1)), keep=("kept",))


@pytest.mark.parametrize("bits", [0, 3, 64])
def test_buckets_settle_with_any_hash(bits, tmp_path, monkeypatch):
    """Equal hashes of different contents, and tables too small for a content, change nothing; no file is left."""
    monkeypatch.setenv("TMPDIR", str(tmp_path))
    monkeypatch.setattr(exact.tempfile, "tempdir", str(tmp_path))
    rng = np.random.default_rng(bits)
    contents = [bytes(rng.integers(0, 3, rng.integers(0, 6)).astype(np.uint8)) for _ in range(2_000)] + [b"x" * 5_000] * 3
    hashes = {c: int.from_bytes(hashlib.md5(c).digest()[:8], "little", signed=True) >> (64 - bits) if bits else 0 for c in set(contents)}
    records = [exact.Record(hashes[c], c, k, 1 + k % 3, (False, k, k)) for k, c in enumerate(contents)]
    size, first = Counter(), {}
    for r in records:
        size[r.content] += r.n
        first[r.content] = min(first.get(r.content, r.first), r.first)
    for held in (1, 10_000, exact.HELD):
        got = {name: (n, low) for name, n, low in exact.settled(iter(records), held)}
        assert got == {r.name: (size[r.content], first[r.content]) for r in records}
    assert not list(tmp_path.iterdir())


def test_clashing_names_are_refused(spark):
    from concordat.llm import classifier, mixing, private

    docs, labels = cases.frame(spark), cases.labels(spark)
    for refused in (
        lambda: mixing.mix_sources(docs, keep=("size",)),
        lambda: private.private_spans(docs.withColumn("spans", F.lit(1)), keep=("spans",)),
        lambda: classifier.quality_scores(docs, labels, keep=("score",)),
        lambda: exact.exact_duplicates(docs, keep=("kept",)),
    ):
        with pytest.raises(ValueError, match="names of the operator's own"):
            refused()
