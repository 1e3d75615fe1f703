"""Sharding by vector bin packing: bytes, tokens and rows are balanced jointly.

Rows with equal texts form a group. A group goes to the shard where the dot product of its
(bytes, tokens, rows) vector with the shard's residual capacity is highest among those that
still have room in bytes. Tokens are words, runs of anything but white space. Packing runs in
levels, so no task and not the driver ever sees all groups:

1. Groups are hashed into buckets of about ``GROUPS_PER_BUCKET``; each bucket is packed on its
   own into as many bins as there are shards.
2. The bins of ``FAN`` buckets are packed into as many bins again, and so on, while there are more
   than ``DRIVER_BINS`` of them.
3. The driver packs the bins that are left into the shards by the same rule, largest first.

A group that would fill more than a ``1/SPLIT`` of a shard in any dimension is split by a hash of
the row's number beforehand; there are at most 3 x SPLIT x shards such groups, so their list has a
bound and is broadcast.

Defined cases: a null text has no bytes and no tokens but is a row; a null id takes part like any
other; repeated rows are rows of their own; an empty table gives an empty result; further columns
of the input are ignored. All shards together hold each row once; ``slot`` numbers the rows of a
shard from 0 without gaps.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkspan.llm.common import WORD, discard, materialise, table, text_of

SHARDS = 40
GROUPS_PER_BUCKET = 4096
FAN = 1024
DRIVER_BINS = 600_000
#: A group above this part of a shard is split.
SPLIT = 16
#: Bytes that a row takes besides its text.
ROW_BYTES = 16


def place(vectors: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each vector: largest first, to the highest dot product with what is left of the shards.

    Shards without room for the vector's bytes are passed over while any has room. Ties go to the
    lowest shard number; equal vectors are placed in the order given.
    """
    total = vectors.sum(axis=0).astype(float)
    total[total == 0] = 1
    v = vectors / total * shards
    left = np.ones((shards, vectors.shape[1]))
    out = np.zeros(len(v), dtype=np.int32)
    order = np.lexsort((np.arange(len(v)), -v.max(axis=1)))
    for i in order:
        x = v[i]
        fit = left @ x
        room = left[:, 0] >= x[0]
        if room.any():
            fit = np.where(room, fit, -np.inf)
            s = int(fit.argmax())
        else:
            s = int(left[:, 0].argmax())
        left[s] -= x
        out[i] = s
    return out


def _places(vectors: np.ndarray, shards: int, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bin of each vector, and how many rows come before its own there."""
    bins = place(vectors.astype(float), shards)
    order = np.argsort(bins, kind="stable")
    before = np.cumsum(rows[order]) - rows[order]
    sizes = np.bincount(bins, minlength=shards)
    first = np.cumsum(sizes) - sizes
    opens = before[np.minimum(first[bins[order]], max(len(bins) - 1, 0))]
    out = np.empty(len(bins), np.int64)
    out[order] = before - opens
    return bins, out


def _pack_bucket(shards: int):
    def pack(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("group", "ascending"), ("salt", "ascending"), ("uid", "ascending")])
        group, salt = rows["group"].to_numpy(), rows["salt"].to_numpy()
        code = np.cumsum(np.concatenate([[False], (group[1:] != group[:-1]) | (salt[1:] != salt[:-1])]))
        n = int(code[-1]) + 1
        counts = np.bincount(code, minlength=n)
        vectors = np.stack([*(np.bincount(code, weights=rows[c].to_numpy(), minlength=n) for c in ("size", "tokens")), counts], axis=1)
        bins, before = _places(vectors, shards, counts)
        at = before[code] + np.arange(len(code)) - (np.cumsum(counts) - counts)[code]
        kept = rows.select(["doc_id", "size", "tokens", "text_crc32", "bucket"])
        return kept.append_column("bin", pa.array(bins[code])).append_column("at", pa.array(at))

    return pack


def _pack_bins(shards: int):
    def pack(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("bucket", "ascending"), ("bin", "ascending")])
        bins, before = _places(np.stack([rows[c].to_numpy() for c in ("b", "t", "n")], axis=1), shards, rows["n"].to_numpy())
        return rows.append_column("into", pa.array(bins)).append_column("offset", pa.array(before))

    return pack


def shard(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, tokens, text_crc32, shard and slot of every row of docs."""
    spark = docs.sparkSession
    text = text_of(text_col)
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text) + F.lit(ROW_BYTES)).cast("long").alias("size"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("tokens"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text, F.crc32(text.cast("binary"))).alias("group"),
        F.monotonically_increasing_id().alias("uid"),
    )
    rows = materialise(rows)
    total = rows.agg(F.sum("size").alias("b"), F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n")).first()
    share = [max(x or 0, 1) / (shards * SPLIT) for x in (total.b, total.t, total.n)]
    groups = rows.groupBy("group").agg(F.sum("size").alias("b"), F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n"))
    pieces = F.greatest(F.col("b") / share[0], F.col("t") / share[1], F.col("n") / share[2])
    hot = groups.where((pieces > 1) & (F.col("n") > 1)).select("group", F.least(F.ceil(pieces), F.col("n")).alias("parts"))
    buckets = int(max(1, -(-groups.count() // GROUPS_PER_BUCKET)))
    salt = F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("uid", F.lit(7)), F.col("parts"))).otherwise(F.lit(0)).cast("long")
    salted = rows.join(F.broadcast(hot), "group", "left").select(*rows.columns, salt.alias("salt"))
    bucketed = salted.withColumn("bucket", F.pmod(F.xxhash64("group", "salt", F.lit(11)), F.lit(buckets)).cast("int"))
    local = materialise(
        bucketed.groupBy("bucket").applyInArrow(_pack_bucket(shards), "doc_id long, size long, tokens long, text_crc32 long, bucket int, bin int, at long")
    )
    discard(rows)
    bins = materialise(local.groupBy("bucket", "bin").agg(F.sum("size").alias("b"), F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n")))
    packed = local
    while bins.count() > max(DRIVER_BINS, shards):
        deeper = bins.withColumn("over", F.floor(F.col("bucket") / FAN).cast("int")).groupBy("over")
        deeper = materialise(deeper.applyInArrow(_pack_bins(shards), "bucket int, bin int, b long, t long, n long, over int, into int, offset long"))
        packed = packed.join(deeper.select("bucket", "bin", "over", "into", "offset"), ["bucket", "bin"])
        packed = packed.select("doc_id", "size", "tokens", "text_crc32", F.col("over").alias("bucket"), F.col("into").alias("bin"), (F.col("at") + F.col("offset")).alias("at"))
        bins = materialise(deeper.groupBy(F.col("over").alias("bucket"), F.col("into").alias("bin")).agg(F.sum("b").alias("b"), F.sum("t").alias("t"), F.sum("n").alias("n")))
    last = bins.orderBy("bucket", "bin").toArrow()
    placed, before = _places(np.stack([last[c].to_numpy() for c in ("b", "t", "n")], axis=1), shards, last["n"].to_numpy())
    where = pa.table({"bucket": last["bucket"], "bin": last["bin"], "shard": pa.array(placed, pa.int32()), "offset": pa.array(before, pa.int64())})
    return packed.join(F.broadcast(spark.createDataFrame(where)), ["bucket", "bin"]).select("doc_id", "size", "tokens", "text_crc32", "shard", (F.col("offset") + F.col("at")).alias("slot"))


def op8_vector_bin_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards whose bytes are nearly equal (law ``bytes``)."""
    return shard(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "tokens"
    )
