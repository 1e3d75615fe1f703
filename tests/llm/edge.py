"""Small tables with the cases that every operator has to bear."""

from pyspark.sql import DataFrame, SparkSession

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "lorem ipsum dolor " * 20_000 + "x" * 60_000


def documents(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Rows of (doc_id, text[, lang[, source]])."""
    full = [(*r, "en", "src1")[:2] + (r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "src1", len(r[1]) if r[1] is not None else None) for r in rows]
    return spark.createDataFrame(full, DOCUMENTS)


def edge_rows() -> list[tuple]:
    same = "The same words stand here again and again, in every copy of this text."
    return [
        (1, None), (2, ""), (3, "   \n\t "), (None, same), (5, same), (5, same), (6, "é ü ß 日本 😀"), (7, LONG), (8, "one"), (9, "one two", None, None),
        (10, same.upper(), None, "src2"), (11, "a b\x0bc\x0cd\r\ne"),
    ]


def clashing(df: DataFrame) -> DataFrame:
    """The same rows with further columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    names = ("uid", "n", "host", "score", "text_", "kind", "start", "end", "shard", "bucket", "size", "digest", "item", "row_uid", "common_", "spans_", "done_", "redacted_", "removed_words")
    return df.select("*", *(F.lit("x").alias(n) for n in names))
