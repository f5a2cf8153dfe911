"""A kept index of texts against brute force, through changes, merges and stale writers."""

import random

import pytest

from concordat.operators import kept_index
from concordat.plans import stored

NEEDLES = ["a", "b", "ab", "ba", "aba", "abab", "bbbb", "cab", "zzz", "é", "é b", "", None, "ab"]


def snapshot(spark, held):
    return spark.createDataFrame([(k, t, "x") for k, t in held], "key string, text string, needle string")


def found(spark, folder):
    rows = kept_index.search(spark, folder, spark.createDataFrame([(n,) for n in NEEDLES], "needle string")).collect()
    assert len(rows) == len(set(map(tuple, rows)))
    return sorted(tuple(r) for r in rows)


def forced(held):
    return sorted((n, k) for n in set(NEEDLES) if n for k, t in held.items() if n in (t or ""))


def test_changes_equal_a_new_index(spark, tmp_path):
    rng = random.Random(3)
    folder, held = f"file://{tmp_path}/index", {}
    for step in range(5):
        for key in [k for k in held if rng.random() < 0.2]:
            del held[key]
        for i in range(12):
            held[f"k{rng.randint(0, 40)}"] = rng.choice([None, "", "ab" * 3000, "".join(rng.choices("abc é", k=rng.randint(1, 12)))])
        done = kept_index.change(spark, folder, snapshot(spark, held.items()), slots=3, most=3)
        assert done["state"] == step + 1
        assert {r["key"]: r["text"] for r in kept_index.texts(spark, folder).collect()} == {k: t or "" for k, t in held.items()}
        assert found(spark, folder) == forced(held)
    # The fourth change met three segments and made one of all; the fifth added one.
    assert sum(n.startswith("texts-") for n in stored.current(spark, folder)[1]) == 2
    assert stored.purge(spark, folder) > 0 and stored.purge(spark, folder) == 0
    assert found(spark, folder) == forced(held)


def test_only_what_differs_is_written(spark, tmp_path):
    folder = f"file://{tmp_path}/index"
    assert kept_index.change(spark, folder, snapshot(spark, [("a", "one"), ("b", "two"), ("b", "also"), (None, "lost")])) == {"state": 1, "added": 2, "removed": 0}
    assert {tuple(r) for r in kept_index.texts(spark, folder).collect()} == {("a", "one"), ("b", "also")}
    assert kept_index.change(spark, folder, snapshot(spark, [("a", "one"), ("b", "also")])) == {"state": 1, "added": 0, "removed": 0}
    assert kept_index.change(spark, folder, snapshot(spark, [("a", "uno"), ("c", "one")])) == {"state": 2, "added": 2, "removed": 2}
    tables = stored.current(spark, folder)[1]
    assert {tuple(r) for r in tables["texts-2"].collect()} == {("a", "uno"), ("c", "one")}
    assert {r["key"] for r in tables["postings-2"].collect()} == {"a", "c"}
    got = kept_index.search(spark, folder, spark.createDataFrame([("on",), ("al",), ("un",)], "needle string"))
    assert {tuple(r) for r in got.collect()} == {("on", "c"), ("un", "a")}


def test_an_emptied_index_and_a_scan_of_few_slots(spark, tmp_path):
    folder = f"file://{tmp_path}/index"
    kept_index.change(spark, folder, snapshot(spark, [(f"k{i}", f"text {i}") for i in range(200)]), slots=16)
    got = kept_index.search(spark, folder, spark.createDataFrame([("xt 19",)], "needle string"))
    assert {r["key"] for r in got.collect()} == {"k19", *(f"k{i}" for i in range(190, 200))}
    slots = {r["slot"] for r in stored.current(spark, folder)[1]["postings-1"].select("slot").distinct().collect()}
    assert slots == set(range(16))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert kept_index.change(spark, folder, snapshot(spark, [])) == {"state": 2, "added": 0, "removed": 200}
    assert found(spark, folder) == []


def test_a_writer_of_an_old_state_is_refused(spark, tmp_path):
    folder = f"file://{tmp_path}/index"
    kept_index.change(spark, folder, snapshot(spark, [("a", "aba")]))
    before = found(spark, folder)
    with pytest.raises(stored.StalePlan):
        stored.publish(spark, folder, {"texts-9": snapshot(spark, [("z", "aba")])}, after=0)
    # Files of a change without a manifest, as a lost writer leaves them, count for nothing.
    snapshot(spark, [("z", "aba")]).write.parquet(f"{folder}/data/texts-2-lost")
    assert found(spark, folder) == before
    assert stored.purge(spark, folder) == 1
