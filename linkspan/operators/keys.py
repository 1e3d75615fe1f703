"""Blocking keys: each record's bounded set of keys, all scoped to its country."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkspan.functions.text import ADDRESS_STOP, is_number, numbers

#: Parts of a key stand apart by a character that no token holds; the words within a part by another.
SEP, INNER = "\x01", "\x02"
KINDS = ("exact", "compact", "token", "name_pair", "number_name", "name_gram", "address_pair", "number_address", "address_exact")
KINDS_V1 = ("exact", "token", "pair", "number_name", "prefix")


def _none() -> Column:
    return F.array().cast("array<string>")


def by_length(tokens: Column, most: int) -> Column:
    """The longest tokens first, equal lengths in order."""
    keyed = F.array_sort(F.transform(tokens, lambda t: F.struct((-F.length(t)).alias("n"), t.alias("t"))))
    return F.slice(F.transform(keyed, lambda x: x["t"]), 1, most)


def pairs(tokens: Column, most: int) -> Column:
    """Each two of the first tokens, in order."""
    first = F.slice(tokens, 1, most)
    two = F.transform(first, lambda a, i: F.transform(F.slice(first, i + 2, most), lambda b: F.concat_ws(SEP, F.least(a, b), F.greatest(a, b))))
    return F.flatten(two)


def crossed(a: Column, b: Column) -> Column:
    return F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: F.concat_ws(SEP, x, y))))


def _grams(tokens: Column) -> Column:
    long = F.filter(F.slice(tokens, 1, 3), lambda t: F.length(t) >= 6)
    return F.flatten(F.transform(long, lambda t: F.transform(F.sequence(F.lit(1), F.least(F.length(t) - 3, F.lit(24))), lambda i: F.substring(t, i, F.lit(4)))))


def key_parts(kind: str, name: Column, compact: Column, nt: Column, at: Column) -> Column:
    """The keys of one kind, without kind and country."""
    tokens = by_length(nt, 8)
    nums = F.slice(numbers(at), 1, 4)
    place = by_length(F.filter(at, lambda t: (F.length(t) >= 3) & ~is_number(t) & ~t.isin(*ADDRESS_STOP)), 8)
    return {
        "exact": lambda: F.when(name != "", F.array(name)).otherwise(_none()),
        "compact": lambda: F.when(name != "", F.array(compact)).otherwise(_none()),
        "token": lambda: F.filter(tokens, lambda t: F.length(t) >= 4),
        "name_pair": lambda: pairs(tokens, 6),
        "pair": lambda: pairs(tokens, 6),
        "number_name": lambda: crossed(nums, F.slice(tokens, 1, 4)),
        "name_gram": lambda: _grams(tokens),
        "prefix": lambda: F.transform(F.filter(F.slice(tokens, 1, 3), lambda t: F.length(t) >= 6), lambda t: F.substring(t, 1, 5)),
        "address_pair": lambda: pairs(place, 6),
        "number_address": lambda: crossed(nums, F.slice(place, 1, 4)),
        "address_exact": lambda: F.when(F.size(at) > 0, F.array(F.array_join(at, INNER))).otherwise(_none()),
    }[kind]()


def keys(records: DataFrame, kinds: tuple[str, ...] = KINDS) -> Column:
    """All distinct keys of prepared records (name, compact, nt, at, country)."""
    cols = [F.col(c) for c in ("name", "compact", "nt", "at")]

    def scoped(kind: str) -> Column:
        return F.transform(key_parts(kind, *cols), lambda p: F.concat_ws(SEP, F.lit(kind), F.col("country"), p))

    return F.array_distinct(F.concat(*map(scoped, kinds)))
