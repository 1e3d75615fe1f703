"""Tables that a plan reads more than once, written down in the folder that the cluster shares."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names; a folder under /tmp only where it names none and all runs on one machine, as in tests."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "/tmp/checkpoints"
    return found.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """The rows, written once and read from there by every use. They stay until the folder is cleared."""
    path = f"{folder(df.sparkSession)}/records-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
