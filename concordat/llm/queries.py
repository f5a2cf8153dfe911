"""The registered queries of this subpackage, and SQL for those that it can express.

SQL is given where DuckDB can compute the same rows: for line dedup, source divergence, filter interplay and
exact dedup. The other operators hash, learn, tokenise or iterate; their tests compare them with brute
force, round trips or held-out accuracy.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from concordat.llm import bpe, classifier, divergence, exact, fingerprint, interplay, langid, lines, minhash, mixing, private, rules, token_files


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def vocabulary(name: str) -> str:
    """Where a public tokenizer file lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_edits(documents(spark, sf_dir))


def op2_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.remove_repeats(documents(spark, sf_dir))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir), words=2, percent=80)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality_rules(documents(spark, sf_dir), labels(spark, sf_dir))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.quality_scores(documents(spark, sf_dir), labels(spark, sf_dir))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.languages(documents(spark, sf_dir))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(documents(spark, sf_dir))


def op9_private(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private.private_spans(documents(spark, sf_dir))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"), end_id=2)


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(documents(spark, sf_dir))


def op12_filter_interplay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interplay.filter_interplay(documents(spark, sf_dir), labels(spark, sf_dir))


def op13_exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(documents(spark, sf_dir))


OPERATORS = (
    op1_fingerprints,
    op2_lines,
    op3_bpe,
    op4_near_duplicates,
    op5_quality_rules,
    op6_quality,
    op7_language,
    op8_mixing,
    op9_private,
    op10_token_files,
    op11_source_divergence,
    op12_filter_interplay,
    op13_exact_duplicates,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in OPERATORS}


def oracle_sql() -> dict[str, str]:
    return {"op2_lines": lines.SQL, "op11_source_divergence": divergence.SQL, "op12_filter_interplay": interplay.SQL, "op13_exact_duplicates": exact.SQL}
