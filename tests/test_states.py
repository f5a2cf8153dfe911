"""Nearest durations, kept plans with states that become visible together, and counts kept by a stream."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from concordat.operators import linkage
from concordat.plans import stored, versions
from concordat.streaming import gates


@pytest.mark.parametrize("k", [1, 5, 50])
def test_nearest_durations_by_force(spark, k):
    rng = random.Random(k)
    durations = [None, 0, 1, 59_999, 60_000, 60_001, 120_000, 10**9, *(rng.randint(0, 400_000) for _ in range(40)), *[77_777] * 90]
    files = [(f"f{i}", d) for i, d in enumerate(durations[:60] + [77_777, 77_800])]
    tracks = [(f"u{i:03}", d) for i, d in enumerate(rng.sample(durations, len(durations)))]
    got = linkage.nearest_durations(spark.createDataFrame(files, "file_path string, duration_ms long"), spark.createDataFrame(tracks, "uri string, duration_ms long"), k=k)
    want = []
    for f, d in files:
        near = sorted((abs(d - t), u) for u, t in tracks if t is not None and abs(d - t) <= 60_000) if d is not None else []
        want += [(f, u, gap, r) for r, (gap, u) in enumerate(near[:k], 1)]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    empty = spark.createDataFrame([], "uri string, duration_ms long")
    assert linkage.nearest_durations(spark.createDataFrame(files, "file_path string, duration_ms long"), empty).count() == 0


PLAYLISTS, TRACKS, PAIRS = "playlist_id string, name string, token string", "uri string, title string, artists string, album string, duration_ms long, added_at string", "uri string, playlist_id string"


def tables(spark, playlists, tracks, pairs):
    return {
        "playlists": spark.createDataFrame(playlists, PLAYLISTS),
        "tracks": spark.createDataFrame([(u, t, "a", None, 1, None) for u, t in tracks], TRACKS),
        "pairs": spark.createDataFrame(pairs, PAIRS),
    }


def rows(found):
    return {name: sorted(tuple(r)[:2] for r in df.collect()) for name, df in found.items()}


@pytest.fixture
def state(spark, tmp_path):
    old = tables(spark, [("p", "P", "1"), ("q", "Q", "1"), ("gone", "G", "1")], [("u", "U"), ("v", "V"), ("w", "W")], [("u", "p"), ("v", "q"), ("w", "p"), ("u", "gone")])
    new = tables(spark, [("p", "P2", "2"), ("q", "Q", "1"), ("r", "R", "1")], [("u", "U2"), ("v", "V"), ("x", "X")], [("x", "p"), ("u", "p"), ("x", "q"), ("v", "r"), ("lost", "r")])
    root = f"file://{tmp_path}/catalog"
    assert stored.current(spark, root) == (0, {})
    stored.publish(spark, root, old, after=0)
    return root, new


def test_a_kept_plan_is_applied_later(spark, state, tmp_path):
    root, new = state
    plan = f"file://{tmp_path}/plan"
    stored.save_plan(spark, plan, versions.plan_sync(stored.current(spark, root)[1], new), stored.current(spark, root)[1])
    assert stored.apply_saved(spark, root, plan, versions.apply_sync) == 2
    number, now = stored.current(spark, root)
    assert number == 2 and rows(now) == {
        "playlists": [("p", "P2"), ("q", "Q"), ("r", "R")],
        "tracks": [("u", "U2"), ("v", "V"), ("x", "X")],
        "pairs": [("u", "p"), ("v", "q"), ("v", "r"), ("x", "p")],
    }
    # Applied twice, it meets tables that it wasn't made from.
    with pytest.raises(stored.StalePlan, match="playlists"):
        stored.apply_saved(spark, root, plan, versions.apply_sync)
    assert stored.current(spark, root)[0] == 2


def test_a_stale_plan_is_refused(spark, state, tmp_path):
    root, new = state
    plan = f"file://{tmp_path}/plan"
    number, old = stored.current(spark, root)
    stored.save_plan(spark, plan, versions.plan_sync(old, new), old)
    stored.publish(spark, root, {**old, "tracks": old["tracks"].withColumn("title", F.concat("title", F.lit("!")))}, after=number)
    with pytest.raises(stored.StalePlan, match="tracks"):
        stored.apply_saved(spark, root, plan, versions.apply_sync)
    with pytest.raises(stored.StalePlan):
        stored.publish(spark, root, old, after=number)
    with pytest.raises(FileNotFoundError):
        stored.apply_saved(spark, root, f"file://{tmp_path}/none", versions.apply_sync)
    # Rows written anew in another order are the same table.
    stored.publish(spark, root, {name: df.repartition(3) for name, df in old.items()}, after=2)
    assert stored.apply_saved(spark, root, plan, versions.apply_sync) == 4


def test_a_crash_between_tables_leaves_the_old_state(spark, state, tmp_path):
    root, new = state
    number, old = stored.current(spark, root)
    before = rows(old)
    bad = spark.range(1).select(F.raise_error(F.lit("lost")).cast("string").alias("uri"), F.lit("p").alias("playlist_id"))
    with pytest.raises(Exception, match="lost"):
        stored.publish(spark, root, {"playlists": new["playlists"], "tracks": new["tracks"], "pairs": bad}, after=number)
    again, now = stored.current(spark, root)
    assert again == number and rows(now) == before
    assert stored.publish(spark, root, new, after=number) == 2


def test_fingerprints_tell_repeats_and_nulls(spark):
    make = lambda data: spark.createDataFrame(data, "a string, b string")
    one = stored.fingerprint(make([("x", None), ("y", "z")]))
    assert one == stored.fingerprint(make([("y", "z"), ("x", None)]).select("b", "a"))
    for other in ([(None, "x"), ("y", "z")], [("x", None), ("x", None), ("y", "z")], [("x", None)], []):
        assert one != stored.fingerprint(make(other))


def test_counts_kept_by_the_stream(spark, tmp_path):
    at = lambda h: datetime.datetime(2024, 1, 1, h)
    schema = "playlist_id string, ts timestamp, n long"
    deliveries = [
        [("p", at(2), 5), ("p", at(1), 3), ("q", at(1), 0), (None, at(1), 9), ("r", None, 1)],
        [("p", at(2), 5), ("p", at(1), 3), ("p", at(3), 5), ("q", at(2), 4)],  # the first ones again
        [("p", at(1), 99), ("p", at(4), 6), ("p", at(4), 7), ("q", at(3), 4), ("q", at(5), 0)],
    ]
    for k, rows_ in enumerate(deliveries):
        spark.createDataFrame(rows_, schema).write.mode("append").parquet(f"{tmp_path}/in")

        def keep(batch, number):
            batch.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={number}")

        stream = gates.stream_count_changes(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"))
        stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    got = sorted((r["playlist_id"], r["ts"].hour, r["n"], r["before"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [("p", 1, 3, 0), ("p", 2, 5, 3), ("p", 4, 7, 5), ("q", 2, 4, 0), ("q", 5, 0, 4)]
