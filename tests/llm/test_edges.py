"""Every operator and pipeline stage on odd rows and on an empty table."""

import pytest

import corpus_pipeline
from concordat.llm import bpe, classifier, fingerprint, langid, lines, minhash, mixing, private, rules, token_files
from concordat.llm.queries import vocabulary

from . import cases

OPERATORS = {
    "fingerprint": lambda d, l: fingerprint.fingerprint_edits(d),
    "lines": lambda d, l: lines.remove_repeats(d),
    "bpe": lambda d, l: bpe.encode_decode(d, vocabulary("word_bpe_49k.json"), full=True),
    "minhash": lambda d, l: minhash.near_duplicates(d),
    "rules": lambda d, l: rules.quality_rules(d, l),
    "classifier": lambda d, l: classifier.quality_scores(d, l),
    "langid": lambda d, l: langid.languages(d),
    "mixing": lambda d, l: mixing.mix_sources(d),
    "private": lambda d, l: private.private_spans(d),
    "token_files": lambda d, l: token_files.round_trip(d, vocabulary("byte_bpe_50k.json")),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(spark, name):
    docs = cases.frame(spark)
    got = OPERATORS[name](docs, cases.labels(spark)).collect()
    key = lambda v: (v is not None, v or 0)
    assert sorted((r["doc_id"] for r in got), key=key) == sorted((r[0] for r in cases.rows()), key=key)
    again = OPERATORS[name](docs, cases.labels(spark)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](cases.empty(spark), cases.labels(spark)).count() == 0
    assert OPERATORS[name](cases.empty(spark), cases.labels(spark, ())).count() == 0


def test_no_labels(spark):
    docs = cases.frame(spark)
    assert {r["score"] for r in classifier.quality_scores(docs, cases.labels(spark, ())).collect()} == {1.0}
    assert {r["kept"] for r in rules.quality_rules(docs, cases.labels(spark, ())).where("not base_failed").collect()} <= {True}


@pytest.mark.parametrize("empty", [False, True])
def test_stages(spark, tmp_path, empty):
    cases.labels(spark).write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        docs = cases.empty(spark) if empty else spark.createDataFrame(cases.rows(), cases.SCHEMA)
        got = stage(spark, docs, str(tmp_path))
        rows = got.collect()
        assert bool(rows) != empty, name
        if name != corpus_pipeline.STAGES[-1][0]:
            assert got.columns == docs.columns
