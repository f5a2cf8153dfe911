"""Rows that every operator must survive: nulls, empty and very long texts, ties, repeats, clashing columns."""

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

PROSE = "The quick brown fox jumps over the lazy dog while seven wizards quietly boxed five dozen liquor jugs"


def rows():
    out = [
        (1, PROSE, "en", "a", 10),
        (2, PROSE, "en", "a", 10),
        (2, PROSE, "en", "a", 10),
        (3, None, None, None, None),
        (4, "", "en", "b", 0),
        (5, "   \n\t ", "de", "b", 6),
        (None, PROSE, None, "a", 1),
        (None, "kein Name hier", "de", None, 1),
        (6, "word", None, "c", 4),
        (7, "Ünïcödé 🙂 text’s “quotes” ẞ İ ǅ Σς é", "fr", "ü", 9),
        (8, "x" * 200_000, "en", "a", 200_000),
        (9, " ".join(f"w{i % 977} v{i % 31}" for i in range(60_000)), "en", "a", 1),
        (10, "a\nb\nc\nd\nb\nc\nd\n\n", "en", "b", 1),
        (11, "zero\nb\nc\nd", "en", "b", 1),
        (12, "\x00 nul �  line", "en", "b", 1),
    ]
    return out


def frame(spark):
    """The rows with columns whose names operators might use themselves."""
    df = spark.createDataFrame(rows(), SCHEMA)
    for name in ("node", "key", "part", "size", "score", "kept", "k", "n", "label", "copies", "pos"):
        df = df.withColumn(name, F.lit("clash"))
    return df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def labels(spark, pairs=((1, 1, 0), (2, 1, 0), (5, 0, 0), (6, 0, None), (None, 1, 1), (8, 0, 0))):
    return spark.createDataFrame(list(pairs), "doc_id long, quality int, toxic int")
