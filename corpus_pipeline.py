"""A corpus from raw documents in five stages, each one of the numbered operators.

Every stage takes what its predecessor kept as ``docs``; all but the last return the columns of
documents. The stages' rules are those of their operators, for all sizes alike. A stage's result reads
tables that the stage wrote, which stay as long as their caller wants: ``run`` deletes them once it has
written the result, and who calls a stage apart can do so by ``tables_made`` and ``discard``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concordat.llm import bpe, classifier, lines, minhash, mixing
from concordat.llm.queries import labels, vocabulary
from concordat.llm.stage import discard, numbered, table, tables_made

#: A document goes if its calibrated probability of good quality is below this: only where the classifier is sure.
REJECTED_BELOW = 0.5
#: Words in a shingle, and the least similarity in percent.
WORDS, PERCENT = 5, 80


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject, each row by its own score.

    Null, empty and repeated texts and ids are judged like others; an empty table gives no rows.
    """
    names = {c: c if c == "text" else f"__{c}" for c in docs.columns}
    rows = docs.select("doc_id", *[F.col(c).alias(n) for c, n in names.items()])
    scores = classifier.quality_scores(rows, labels(spark, sf_dir), keep=tuple(names.values()))
    return scores.where(F.col("score") >= REJECTED_BELOW).select(*[F.col(n).alias(c) for c, n in names.items()])


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of passages; those of which no word is left go, if lines went.

    Null texts stay null; each row is a document of its own. An empty table gives no rows.
    """
    clean = lines.remove_repeats(docs, keep=("lang", "source"))
    clean = clean.where((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return clean.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: the one of smallest id, null after all others.

    Each row is a document of its own: rows of one id, or with none, are compared by their texts like any
    others, so that only copies go. Texts without words stay. An empty table gives no rows.
    """
    rows = numbered(docs)
    found = minhash.near_duplicates(rows, WORDS, PERCENT, id_col="__row").select(F.col("doc_id").alias("__row"), "component_id")
    found = found.join(rows.select("__row", "doc_id"), "__row")
    first = found.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "__row")).alias("first"))
    return rows.join(first.select("first.__row"), "__row", "left_semi").select(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; those with no copies go.

    Rows without words stay once; null and repeated ids are rows like others. An empty table gives no rows.
    """
    rows = numbered(docs)
    copies = mixing.mix_sources(rows, keep=("__row",)).select("__row", "copies")
    both = rows.join(copies, "__row").where("copies > 0")
    return both.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each copy: count and digests, as the operator gives them; null texts have none, an empty table gives no rows."""
    return bpe.encode_decode(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", near_dedup),
    ("mixing sources", source_mix),
    ("BPE encoding", encode),
]

#: The classifier, the near-dedup's hashes and the tokenizer are beyond SQL; tests compare stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the table of documents, each written and read again.

    What a stage left, and its input, is deleted as soon as its result is written; of other runs and
    callers in the session nothing is touched.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        with tables_made() as made:
            out = table(stage(spark, docs, sf_dir), f"stage-{k}")
        discard(*[t for t in made if t is not out])
        if k:
            discard(docs)
        docs = out
    return STAGES[-1][1](spark, docs, sf_dir)
