"""What the operators of this subpackage share: reading tables, cutting lineage, cleaning input columns."""

from __future__ import annotations

import ctypes
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

#: A word: a run of anything but space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
WORDS = re.compile(WORD)
#: Rows in an Arrow batch sent to Python: texts of up to some MB then fit a worker's memory.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a folder under /tmp only where none is named and all runs on one machine, as in tests."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not found:
        found = sc.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir("/tmp/checkpoints")
        found = sc.getCheckpointDir()
    return found.rstrip("/")


#: Paths that materialise() wrote and nothing has deleted yet.
_scratch: list[str] = []
#: Whether Spark deletes the shuffle files of a query when it ends; else they stay until the driver collects garbage.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame) -> DataFrame:
    """The rows, written once to the shared folder and read from there: lineage ends, and a lost executor costs no more than the reading. The shuffle files of the writing go with it: nothing else reads them."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/linkspan-{uuid.uuid4().hex}"
    before = spark.conf.get(SHUFFLES_GO, None)
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(SHUFFLES_GO)
        else:
            spark.conf.set(SHUFFLES_GO, before)
    _scratch.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    if path in _scratch:
        _scratch.remove(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables that materialise() wrote, once nothing that is still to be read depends on them."""
    for df in tables:
        if path := getattr(df, "_scratch", None):
            _delete(df.sparkSession, path)


def sweep(spark: SparkSession, keep: set[str]) -> None:
    """Delete all tables that materialise() wrote but those in keep: for the end of a job that has written its result elsewhere."""
    for path in [p for p in _scratch if p not in keep]:
        _delete(spark, path)


def scratch_paths() -> set[str]:
    """The tables that materialise() wrote and that are still there."""
    return set(_scratch)


#: Rows up to which a list of row numbers, or what goes with them, is broadcast.
BROADCAST_ROWS = 1_000_000


def pick(df: DataFrame, ids: DataFrame, on: str, how: str) -> DataFrame:
    """df joined with a table of row numbers: by broadcast where it is small, so that df's texts need not move, else by a shuffle."""
    return df.join(F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids, on, how)


#: Rows of one key from which the key counts as hot.
HOT_ROWS = 100_000


def spread(left: DataFrame, right: DataFrame, on: str, rows: str) -> DataFrame:
    """left joined with right, which has one row a key and, in `rows`, how many rows left has of it: hot keys by broadcast (left / HOT_ROWS of them at most), the others by a shuffle, so that no task gathers a hot key."""
    hot = right.where(F.col(rows) > HOT_ROWS).drop(rows)
    n = hot.count()
    if not n:
        return left.join(right.drop(rows), on)
    side = F.broadcast(hot) if n <= BROADCAST_ROWS else hot
    rest = left.join(F.broadcast(hot.select(on)) if n <= BROADCAST_ROWS else hot.select(on), on, "left_anti")
    return left.join(side, on).unionByName(rest.join(right.where(F.col(rows) <= HOT_ROWS).drop(rows), on))


#: Files up to which their numbers are broadcast (about 30 bytes each); beyond, rows are numbered once in a written copy.
BROADCAST_FILES = 1_000_000
#: Rows of a file that a row number has room for.
ROWS_OF_FILE = 1 << 40


def _files(df: DataFrame) -> list[str] | None:
    """The files of df where it is nothing but columns and filters over one file source, in a fixed order; else None."""
    plan = df._jdf.queryExecution().analyzed()
    if not plan.deterministic() or any(c.lower() == "_metadata" for c in df.columns):
        return None
    while plan.getClass().getSimpleName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    if plan.getClass().getSimpleName() != "LogicalRelation":
        return None
    try:
        df.select("_metadata.file_path", "_metadata.row_index")
    except AnalysisException:
        return None
    return sorted(df.inputFiles())


def numbered(df: DataFrame, name: str) -> DataFrame:
    """df with a row number that means the same row at every reading, however the reading is dealt out.

    Rows of files are numbered by their file and their place in it. The rows of any other plan are
    numbered as they come and written down once with their numbers.
    """
    spark, files = df.sparkSession, _files(df)
    if files is not None and len(files) <= BROADCAST_FILES:
        place = F.col("_metadata.row_index")
        if len(files) < 2:
            return df.select("*", place.alias(name))
        path, number = free_name(df, "file_path_"), free_name(df, "file_number_")
        one = lambda c: F.xxhash64(F.regexp_replace(c, "^([^:/]+):/*", "$1:/"))  # noqa: E731  file:/ and file:/// are the same
        known = spark.createDataFrame(pa.table({path: files, number: np.arange(len(files), dtype=np.int64)})).select(one(path).alias(path), number)
        if known.distinct().count() == known.select(path).distinct().count():
            row = F.coalesce(F.col(number), F.raise_error(F.lit("a file that was not listed"))) * F.lit(ROWS_OF_FILE) + F.col(name)
            rows = df.select("*", place.alias(name), one("_metadata.file_path").alias(path)).join(F.broadcast(known), path, "left")
            return rows.select(*df.columns, row.alias(name))
    return materialise(df.select("*", F.monotonically_increasing_id().alias(name)))


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Keep the batches handed to Python workers small: texts are long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def text_of(name: str = "text") -> Column:
    """Null texts count as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that df does not have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def give_back() -> None:
    """Return freed memory to the system: idle workers stay, and stand beside those of the next stage."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def map_texts(df: DataFrame, text_col: str, keep: tuple[str, ...], per_batch: Callable[[], Callable[[list], dict[str, list]]], schema: str) -> DataFrame:
    """`keep`, and the columns that a function makes of the texts (None where null), batch by batch.

    per_batch() is called once in each task and returns the function. The kept columns stay in
    Arrow, so nulls and large integers come through unharmed.
    """
    small_batches(df.sparkSession)
    rows = df.select(*keep, F.col(text_col).alias(free_name(df, "text_in")))
    text_in = rows.columns[-1]
    out = StructType(rows.schema.fields[:-1] + StructType.fromDDL(schema).fields)
    types = [(f.name, to_arrow_type(f.dataType)) for f in StructType.fromDDL(schema).fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = per_batch()
        try:
            for batch in batches:
                made = f(batch.column(text_in).to_pylist())
                kept = [batch.column(c) for c in keep]
                yield pa.RecordBatch.from_arrays([*kept, *(pa.array(made[n], t) for n, t in types)], names=[*keep, *(n for n, _ in types)])
        finally:
            del f
            give_back()

    return rows.mapInArrow(run, out)
