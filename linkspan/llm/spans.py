"""Matches of regular expressions with their places, in built-in expressions only.

Spark returns matches without their places. Splitting by the same expression returns what stands
between them; running sums over both give start and end in code points. The expressions must not
match empty strings, and start where a leftmost search would start anyway: `\\G` (the end of the
match before) or the start of a run. Groups that repeat are possessive, so Java does not recurse.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: White space between words.
SPACES = r"[\x20\x09-\x0D]+"
#: Code points of a block: spans that overlap share one.
BLOCK = 256


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), SPACES), lambda x: x != "")


def _last(words: Column) -> Column:
    return F.slice(words, F.greatest(F.size(words) - 1, F.lit(1)), 2)


def matches(df: DataFrame, uid: str, text: str, kinds: dict[str, str], context: bool = False) -> DataFrame:
    """One row for each match: uid, kind, start, end (exclusive), value, and where asked for its context: l2 and l1, the two words before it, r1 and r2, the two after it (lower-cased, null where there is none).

    The context takes what stands between the matches and, where that is short, the matches of the
    same kind next to it, words of any length being whole. A text's matches are exploded before their
    places are summed, so a text with very many of them makes many short rows rather than one long one.
    """
    empty = F.array().cast("array<string>")
    rows = df.select(uid, *(x for k, (kind, pattern) in enumerate(kinds.items()) for x in (F.split(text, pattern, -1).alias(f"p{k}"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias(f"m{k}"))))
    if context:
        two = lambda c: F.transform(c, lambda x: F.struct(F.slice(_words(x), 1, 2).alias("head"), _last(_words(x)).alias("tail")))
        rows = rows.select("*", *(two(F.col(f"{c}{k}")).alias(f"{c}w{k}") for k in range(len(kinds)) for c in "pm"))

    def around(k: int, i: Column) -> list[Column]:
        at = lambda c, j, end: F.coalesce(F.get(F.col(f"{c}w{k}"), j)[end], empty)
        left = F.concat(at("m", i - 2, "tail"), at("p", i - 1, "tail"), at("m", i - 1, "tail"), at("p", i, "tail"))
        right = F.concat(at("p", i + 1, "head"), at("m", i + 1, "head"), at("p", i + 2, "head"), at("m", i + 2, "head"))
        return [F.get(left, F.size(left) - 2).alias("l2"), F.get(left, F.size(left) - 1).alias("l1"), F.get(right, F.lit(0)).alias("r1"), F.get(right, F.lit(1)).alias("r2")]

    def one(k: int, kind: str) -> Column:
        p = F.col(f"p{k}")
        return F.transform(
            F.col(f"m{k}"),
            lambda m, i: F.struct(
                F.lit(kind).alias("kind"), i.alias("i"), F.length(F.element_at(p, i + 1)).alias("gap"), F.length(m).alias("len"), m.alias("value"), *(around(k, i) if context else ()),
            ),
        )

    found = rows.select(uid, F.explode(F.concat(*(one(k, kind) for k, kind in enumerate(kinds)))).alias("x")).select(uid, "x.*")
    end = F.sum(F.col("gap") + F.col("len")).over(W.partitionBy(uid, "kind").orderBy("i").rowsBetween(W.unboundedPreceding, W.currentRow))
    return found.withColumn("end", end).select(uid, "kind", (F.col("end") - F.col("len")).alias("start"), "end", "value", *(("l2", "l1", "r1", "r2") if context else ()))


def apart(spans: DataFrame, others: DataFrame, uid: str) -> DataFrame:
    """Those of the spans (uid, start, end, ...) that overlap none of the others. They meet by blocks of the text, so a long text with many spans is not held against itself."""
    block = F.explode(F.sequence(F.floor(F.col("start") / BLOCK), F.floor((F.col("end") - 1) / BLOCK)))
    a = spans.select(uid, "start", "end", block.alias("block")).alias("a")
    b = others.select(uid, "start", "end", block.alias("block")).alias("b")
    same = (F.col(f"a.{uid}") == F.col(f"b.{uid}")) & (F.col("a.block") == F.col("b.block"))
    hit = a.join(b, same & (F.col("a.start") < F.col("b.end")) & (F.col("b.start") < F.col("a.end")), "left_semi")
    return spans.join(hit.select(uid, "start", "end").distinct(), [uid, "start", "end"], "left_anti")


def joined(spans: Column, kinds: tuple[str, ...], by_kind: bool) -> Column:
    """kind:start:end of an array of structs (kind, start, end), comma-joined: by start and then kind, or by kind and then start; kinds in the order listed."""
    order = F.create_map(*(x for n, k in enumerate(kinds) for x in (F.lit(k), F.lit(n))))
    keyed = F.transform(
        spans,
        lambda s: F.struct(*((order[s["kind"]].alias("a"), s["start"].alias("b")) if by_kind else (s["start"].alias("a"), order[s["kind"]].alias("b"))), s["end"].alias("e"), s["kind"].alias("k"), s["start"].alias("s")),
    )
    return F.array_join(F.transform(F.array_sort(keyed), lambda s: F.concat_ws(":", s["k"], s["s"].cast("string"), s["e"].cast("string"))), ",")


def per_row(rows: DataFrame, found: DataFrame, uid: str, base: tuple[str, ...], added: tuple[str, ...], by_kind: bool) -> DataFrame:
    """rows with a count of each base kind, base_sha256 and spans."""
    span = F.struct("kind", "start", "end")
    sums = found.groupBy(uid).agg(F.collect_list(span).alias("all_"), *(F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{k}") for k in base))
    out = rows.join(sums, uid, "left")
    everything = F.coalesce("all_", F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>"))
    own = F.filter(everything, lambda s: s["kind"].isin(*base))
    return out.select(
        *rows.columns,
        *(F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in base),
        F.sha2(joined(own, base, by_kind).cast("binary"), 256).alias("base_sha256"),
        joined(everything, (*base, *added), by_kind).alias("spans"),
    )
