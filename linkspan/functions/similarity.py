"""Similarity of two records: set measures as expressions, the sequence ratio as one vectorised function."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from linkspan.functions.text import numbers


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct members; 0 if both are empty."""
    common = F.size(F.array_intersect(a, b)).cast("double")
    return F.coalesce(F.try_divide(common, F.size(a) + F.size(b) - common), F.lit(0.0))


def containment(a: Column, b: Column) -> Column:
    """The part of the smaller set that the other holds; 0 if either is empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.least(F.size(a), F.size(b))), F.lit(0.0))


@F.pandas_udf(DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    known: dict[tuple, float | None] = {}
    out = []
    for pair in zip(a, b, strict=True):
        if pair not in known:
            x, y = pair
            known[pair] = None if x is None or y is None else 1.0 if x == y else SequenceMatcher(None, x, y, autojunk=False).ratio()
        out.append(known[pair])
    return pd.Series(out, dtype="float64")


def sequence_ratio(a: Column, b: Column) -> Column:
    """Twice the matched characters over all characters; 0 if either is empty. The order of the arguments matters."""
    both = (a != "") & (b != "")
    return F.when(both, _ratio(F.when(both, a), F.when(both, b))).otherwise(0.0)


def same_text(a: Column, b: Column) -> Column:
    return ((a == b) & (a != "")).cast("double")


def length_ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(F.least(F.length(a), F.length(b)).cast("double"), F.greatest(F.length(a), F.length(b))), F.lit(0.0))


def _blend(name: Column, address: Column) -> Column:
    return 3 * F.greatest(name, address) + F.least(name, address)


def cheap_score(a: str, b: str) -> Column:
    """Of the structs a and b with nt, at and compact: no sequence ratio."""
    name = F.greatest(jaccard(F.col(f"{a}.nt"), F.col(f"{b}.nt")), same_text(F.col(f"{a}.compact"), F.col(f"{b}.compact")))
    return _blend(name, jaccard(F.col(f"{a}.at"), F.col(f"{b}.at")))


def fine_score(a: str, b: str, ratio: Column) -> Column:
    """With the ratio of the compact names, and the numbers of the addresses."""
    name = F.greatest(jaccard(F.col(f"{a}.nt"), F.col(f"{b}.nt")), ratio)
    extra = 0.3 * jaccard(numbers(F.col(f"{a}.at")), numbers(F.col(f"{b}.at")))
    return _blend(name, jaccard(F.col(f"{a}.at"), F.col(f"{b}.at"))) + extra


def cheap_score_v1(a: str, b: str) -> Column:
    same = (F.col(f"{a}.name") == F.col(f"{b}.name")).cast("double")
    return 3 * jaccard(F.col(f"{a}.nt"), F.col(f"{b}.nt")) + jaccard(F.col(f"{a}.at"), F.col(f"{b}.at")) + 2 * same


def score_v1(a: str, b: str) -> Column:
    x, y = F.col(f"{a}.name"), F.col(f"{b}.name")
    ratio = F.when((x == "") & (y == ""), 1.0).otherwise(sequence_ratio(x, y))
    return cheap_score_v1(a, b) + ratio
