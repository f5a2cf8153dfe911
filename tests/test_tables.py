"""Nothing that a query writes for itself is left once its result was read and its scope discarded."""

import os

import pytest

from concordat import queries_catalog, queries_files, queries_linkage, queries_sources, registry, tables  # noqa: F401

from .conftest import SF


@pytest.mark.parametrize(
    "name",
    ["comp6_link_records", "comp7_assign_one_to_one", "jn17_nearest_durations", "jn24_find_files", "jn25_files_exist", "comp15_validate_playlists", "snk9_nested_document", "snk15_batches", "comp24_stored_plan", "stm1_streamed_counts", "stm2_token_gate", "src9_streamed_playlist_files"],
)
def test_nothing_is_left(spark, name):
    shared = tables.shared_dir(spark).removeprefix("file://")
    os.makedirs(shared, exist_ok=True)
    before = set(os.listdir(shared))
    with tables.tables_made() as made:
        rows = registry.QUERIES[name](spark, SF).collect()
    assert rows and made
    tables.discard(*made)
    assert set(os.listdir(shared)) == before


def test_scopes_know_their_own(spark):
    one = spark.range(3)
    with tables.tables_made() as outer:
        a = tables.staged(one, "a")
        with tables.tables_made() as inner:
            b = tables.staged(one, "b")
        tables.staged(one, "c")
    assert [x is b for x in inner] == [True] and len(outer) == 3 and outer[0] is a
    tables.discard(*inner, *inner)
    assert a.count() == 3
    with pytest.raises(Exception, match="FAILED_READ_FILE|NOT_EXIST|PATH_NOT_FOUND|does not exist"):
        b.count()
    tables.discard(*outer)
