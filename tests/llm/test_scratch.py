import os
import time

from edge import documents, edge_rows
from pyspark.sql import functions as F

from linkspan.llm import common, ngram_join


def shuffle_files(spark):
    found = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
    return {n for n in (found.apply(i).getName() for i in range(found.size())) if n.startswith("shuffle_") and n.endswith(".data")}


def test_shuffle_files_go_with_the_writing(spark):
    """A table is written with two shuffles, and these are not left on disk until the driver collects garbage."""
    before, set_ = shuffle_files(spark), spark.conf.get(common.SHUFFLES_GO, None)
    ids = spark.range(20_000).select("id", F.xxhash64("id").alias("k"))
    out = common.materialise(ids.repartition(3, "k").groupBy("id").agg(F.max("k").alias("k")))
    end = time.time() + 20
    while (left := shuffle_files(spark) - before) and time.time() < end:
        time.sleep(0.2)
    assert not left and out.count() == 20_000 and spark.conf.get(common.SHUFFLES_GO, None) == set_
    common.discard(out)


def test_texts_of_several_files_are_not_copied(spark, tmp_path, monkeypatch):
    """Rows that are numbered by their files need no second numbering, for which all texts were written again."""
    documents(spark, edge_rows()).repartition(3).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    assert len([f for f in os.listdir(tmp_path / "docs") if f.endswith(".parquet")]) > 1
    written = []
    for m in (common, ngram_join):
        monkeypatch.setattr(m, "materialise", lambda df, f=m.materialise: written.append(df.columns) or f(df))
    left = ngram_join.one_of_each(docs)
    assert left.count() < docs.count() and not [c for c in written if {"text", "text_"} & set(c)]
