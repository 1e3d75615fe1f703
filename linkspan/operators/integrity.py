"""Checks of ids, labels and outputs. Each check is a count of rows that break a rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def orphans(links: DataFrame, targets: DataFrame, on: str) -> DataFrame:
    """The links whose target is missing."""
    return links.join(targets.select(on), on, "left_anti")


def duplicates(df: DataFrame, on: list[str]) -> DataFrame:
    return df.groupBy(*on).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def shared_owners(links: DataFrame, tid: str, eid: str) -> DataFrame:
    """Targets that more than one entity claims."""
    return links.select(tid, eid).distinct().groupBy(tid).agg(F.count(F.lit(1)).alias("owners")).where(F.col("owners") > 1)


def conflicting_links(links: DataFrame, tid: str, eid: str, order: str) -> DataFrame:
    """Links whose target was claimed by another entity first."""
    first = F.first(eid).over(W.partitionBy(tid).orderBy(order, eid))
    return links.withColumn("first_owner", first).where(F.col("first_owner") != F.col(eid))


def disagreements(links: DataFrame, left: DataFrame, right: DataFrame, eid: str, tid: str) -> DataFrame:
    """Links whose ends have different countries; a missing entity counts as different."""
    a = left.select(eid, F.col("country").alias("a_country"))
    b = right.select(tid, F.col("country").alias("b_country"))
    both = links.join(a, eid, "left").join(b, tid, "inner")
    return both.where(~F.col("a_country").eqNullSafe(F.col("b_country")))


def id_prefix(c: Column, source: int) -> Column:
    return c.startswith(f"S{source}-")


def report(checks: dict[str, DataFrame]) -> DataFrame:
    """A row for each check: its failures, and PASS or FAIL."""
    out = None
    for i, (name, rows) in enumerate(checks.items()):
        one = rows.agg(F.lit(i).alias("step"), F.lit(name).alias("check"), F.count(F.lit(1)).alias("failures"))
        out = one if out is None else out.unionByName(one)
    return out.withColumn("status", F.when(F.col("failures") == 0, "PASS").otherwise("FAIL"))


def require(ids: DataFrame, known: DataFrame, on: str, what: str) -> DataFrame:
    """ids, if each is known; else ValueError with how many are not and the first of them."""
    lost = ids.select(on).distinct().join(known.select(on), on, "left_anti")
    first = [r[0] for r in lost.orderBy(on).limit(5).collect()]
    if first:
        raise ValueError(f"{lost.count()} {what} are missing, among them {first}")
    return ids


def tallies(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """For each table its rows and the distinct values of its key."""
    out = None
    for i, (name, (df, key)) in enumerate(tables.items()):
        one = df.agg(F.lit(i).alias("step"), F.lit(name).alias("name"), F.count(F.lit(1)).alias("n_rows"), F.count_distinct(key).alias("n_keys"))
        out = one if out is None else out.unionByName(one)
    return out


def issues(checks: dict[str, DataFrame], most: int = 20) -> DataFrame:
    """The first rows that break a rule, at most so many of each check, as JSON."""
    out = None
    for name, rows in checks.items():
        one = rows.select(F.lit(name).alias("check"), F.to_json(F.struct(*rows.columns)).alias("issue")).orderBy("issue").limit(most)
        out = one if out is None else out.unionByName(one)
    return out


def output_checks(source: DataFrame, candidates: DataFrame, matches: DataFrame, most: int = 100) -> DataFrame:
    """For each row of the outputs (eid, pos, ids as an array) the rules it breaks: alignment with the source, repeats, too many, wrong sources, matches beyond the candidates."""
    s = source.select("eid", F.col("pos").alias("s_pos"))
    c = candidates.select("eid", F.col("pos").alias("c_pos"), F.col("ids").alias("c_ids"))
    m = matches.select("eid", F.col("pos").alias("m_pos"), F.col("ids").alias("m_ids"))
    all_ = s.join(c, "eid", "full").join(m, "eid", "full")
    bad_id = lambda x: ~(id_prefix(x, 2) | id_prefix(x, 3))
    rules = {
        "misaligned": ~(F.col("s_pos").eqNullSafe(F.col("c_pos")) & F.col("s_pos").eqNullSafe(F.col("m_pos"))),
        "repeated": (F.size(F.array_distinct("c_ids")) < F.size("c_ids")) | (F.size(F.array_distinct("m_ids")) < F.size("m_ids")),
        "too_many": F.size("c_ids") > most,
        "wrong_source": F.exists("c_ids", bad_id) | F.exists("m_ids", bad_id),
        "beyond_candidates": F.size(F.array_except("m_ids", "c_ids")) > 0,
    }
    return all_.select("eid", *(F.coalesce(r, F.lit(False)).alias(n) for n, r in rules.items()))
