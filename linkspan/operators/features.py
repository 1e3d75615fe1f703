"""The 23 features of a pair of records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkspan.functions import similarity as sim
from linkspan.functions import text

#: The features' names, in the order that models expect.
FEATURES = (
    "name_ratio name_token_jaccard name_token_containment name_compact_equal name_3gram_jaccard name_4gram_jaccard name_length_ratio "
    "address_token_jaccard address_token_containment address_ratio number_jaccard number_equal number_conflict postcode_jaccard "
    "address_missing_query address_missing_target country_equal name_digit_jaccard name_ascii_query name_ascii_target "
    "ranking_score name_tokens_query name_tokens_target"
).split()
SEQUENCE_BASED = ("name_ratio", "address_ratio", "ranking_score")


def expressions(ratio: Column | None = None) -> dict[str, Column]:
    """All features of the structs a and b; ratio: that of the compact names, where it is at hand."""
    a = {c: F.col(f"a.{c}") for c in ("compact", "nt", "at", "country")}
    b = {c: F.col(f"b.{c}") for c in ("compact", "nt", "at", "country")}
    an, bn = text.numbers(a["at"]), text.numbers(b["at"])
    none = lambda x: (F.size(x) == 0).cast("double")
    ratio = sim.sequence_ratio(a["compact"], b["compact"]) if ratio is None else ratio
    line = lambda x: F.array_join(x, " ")
    return {
        "name_ratio": ratio,
        "name_token_jaccard": sim.jaccard(a["nt"], b["nt"]),
        "name_token_containment": sim.containment(a["nt"], b["nt"]),
        "name_compact_equal": sim.same_text(a["compact"], b["compact"]),
        "name_3gram_jaccard": sim.jaccard(text.grams(a["compact"], 3), text.grams(b["compact"], 3)),
        "name_4gram_jaccard": sim.jaccard(text.grams(a["compact"], 4), text.grams(b["compact"], 4)),
        "name_length_ratio": sim.length_ratio(a["compact"], b["compact"]),
        "address_token_jaccard": sim.jaccard(a["at"], b["at"]),
        "address_token_containment": sim.containment(a["at"], b["at"]),
        "address_ratio": sim.sequence_ratio(line(a["at"]), line(b["at"])),
        "number_jaccard": sim.jaccard(an, bn),
        "number_equal": ((F.size(an) > 0) & (an == bn)).cast("double"),
        "number_conflict": ((F.size(an) > 0) & (F.size(bn) > 0) & ~F.arrays_overlap(an, bn)).cast("double"),
        "postcode_jaccard": sim.jaccard(text.postcodes(a["at"]), text.postcodes(b["at"])),
        "address_missing_query": none(a["at"]),
        "address_missing_target": none(b["at"]),
        "country_equal": (a["country"] == b["country"]).cast("double"),
        "name_digit_jaccard": sim.jaccard(text.numbers(a["nt"]), text.numbers(b["nt"])),
        "name_ascii_query": text.is_ascii(a["compact"]).cast("double"),
        "name_ascii_target": text.is_ascii(b["compact"]).cast("double"),
        "ranking_score": sim.fine_score("a", "b", ratio),
        "name_tokens_query": F.size(a["nt"]).cast("double"),
        "name_tokens_target": F.size(b["nt"]).cast("double"),
    }


def with_features(pairs: DataFrame, names: tuple[str, ...] = tuple(FEATURES)) -> DataFrame:
    """pairs and the features asked for. Where pairs have a ratio already it is not worked out again."""
    found = expressions(F.col("ratio") if "ratio" in pairs.columns else None)
    return pairs.withColumns({n: found[n] for n in names})
