"""Candidates: the join of records over shared keys, and their ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linkspan.functions import similarity as sim
from linkspan.operators.keys import KINDS, keys

CAP = 100
PREFILTER = 500
CANDIDATES = 100


def postings(records: DataFrame, id_col: str, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """(key, id) of every record."""
    return records.select(F.explode(keys(records, kinds)).alias("key"), id_col)


def bucket_sizes(queries: DataFrame, targets: DataFrame) -> DataFrame:
    """key and its number of targets, for the keys that a query has. Counts are summed within tasks before the shuffle, so a common key is no hot one."""
    asked = queries.select("key").distinct()
    return targets.join(asked, "key", "left_semi").groupBy("key").agg(F.count(F.lit(1)).alias("n"))


def pool(queries: DataFrame, targets: DataFrame, cap: int = CAP) -> DataFrame:
    """The distinct (eid, tid) that share a key of at most `cap` targets. Larger buckets are left out whole."""
    kept = bucket_sizes(queries, targets).where(F.col("n") <= cap).select("key")
    return queries.join(targets.join(kept, "key", "left_semi"), "key").select("eid", "tid").distinct()


ATTRIBUTES = ("name", "compact", "nt", "at", "country")
#: What the cheap score reads.
CHEAP = ("compact", "nt", "at")


def attach(pairs: DataFrame, refs: DataFrame, targets: DataFrame, names: tuple[str, ...] = ATTRIBUTES, strict: bool = False) -> DataFrame:
    """pairs with the records a and b. Attributes join late: keys travel without them. strict: a pair whose record is missing fails the job rather than being left out."""
    a = refs.select("eid", F.struct(*names).alias("a"))
    b = targets.select("tid", F.struct(*names).alias("b"))
    if not strict:
        return pairs.join(b, "tid").join(a, "eid")
    out = pairs.join(b, "tid", "left").join(a, "eid", "left")
    missing = lambda c, key: F.when(F.col(c).isNull(), F.raise_error(F.concat(F.lit("no record "), F.col(key))).cast(out.schema[c].dataType)).otherwise(F.col(c))
    return out.withColumn("a", missing("a", "eid")).withColumn("b", missing("b", "tid"))


def top(pairs: DataFrame, score: str, k: int, ties_descending: bool) -> DataFrame:
    """The k best targets of each record, with their rank. The window's limit is applied within tasks first."""
    tie = F.desc("tid") if ties_descending else F.asc("tid")
    w = W.partitionBy("eid").orderBy(F.desc(score), tie)
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def may_rank(pairs: DataFrame, limit: int) -> DataFrame:
    """pairs (a, b) without those that cannot be among the first `limit` by the full score, whatever their sequence ratio.

    The ratio is at least 0, and at most twice the shorter length over both lengths. A pair goes if
    `limit` others of its record are sure to score more.
    """
    la, lb = F.length("a.compact"), F.length("b.compact")
    most = F.coalesce(F.try_divide(2.0 * F.least(la, lb), la + lb), F.lit(0.0))
    bounds = pairs.withColumn("least_", sim.fine_score("a", "b", F.lit(0.0))).withColumn("most_", sim.fine_score("a", "b", most))
    w = W.partitionBy("eid").orderBy(F.desc("least_")).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    sure = F.nth_value("least_", limit).over(w)
    return bounds.withColumn("sure_", sure).where(F.col("sure_").isNull() | (F.col("most_") >= F.col("sure_"))).drop("least_", "most_", "sure_")


def rank(pairs: DataFrame, refs: DataFrame, targets: DataFrame, prefilter: int = PREFILTER, limit: int = CANDIDATES) -> DataFrame:
    """The two steps of ranking pairs (eid, tid): a cheap score over all of them, the full score over what it keeps. Pairs are cut before whole records join."""
    scored = attach(pairs, refs, targets, CHEAP).select("eid", "tid", sim.cheap_score("a", "b").alias("cheap"))
    kept = attach(top(scored, "cheap", prefilter, ties_descending=True).drop("rank"), refs, targets)
    ratio = may_rank(kept, limit).withColumn("ratio", sim.sequence_ratio(F.col("a.compact"), F.col("b.compact")))
    return top(ratio.withColumn("score", sim.fine_score("a", "b", F.col("ratio"))), "score", limit, ties_descending=False)


def candidates(refs: DataFrame, targets: DataFrame, cap: int = CAP, prefilter: int = PREFILTER, limit: int = CANDIDATES) -> DataFrame:
    """eid, tid, rank, score and both records, for prepared records."""
    found = pool(postings(refs, "eid"), postings(targets, "tid"), cap)
    return rank(found, refs, targets, prefilter, limit)
