"""Matching in micro-batches: new reference files are matched against a fixed index.

A batch's output replaces what an interrupted attempt at the same batch left, so a restart from the
checkpoint neither loses nor repeats records.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from linkspan.plans.linkage import match_exact
from linkspan.sources.records import SCHEMA, prepare


def stream_matches(spark: SparkSession, source: str, targets: DataFrame, out: str, checkpoint: str, match=match_exact) -> StreamingQuery:
    """A query that matches all files in a folder as far as they are there, then ends. targets: prepared, with tid."""
    rows = spark.readStream.options(sep="\t", header=True, quote='"', escape='"').schema(SCHEMA).csv(source)

    def one(batch: DataFrame, number: int) -> None:
        refs = prepare(batch.fillna("")).withColumnRenamed("entity_id", "eid")
        match(refs, targets).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return rows.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
