"""Language identification by rank-order profiles of character n-grams.

A profile lists the most frequent 1- to 3-grams of a language by rank. A document's own most
frequent n-grams are compared with each profile by the out-of-place distance: the sum, over the
document's n-grams, of how far the ranks differ, or of the profile's length where the profile lacks
the n-gram. The closest language wins; ties go to the first in alphabetical order.

Letters are lower-cased; all else parts words and counts as one space. Profiles are fitted on at
most ``FIT_DOCS`` different labelled texts of each language, those with the lowest hashes. Prediction reads the text alone.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; without any labelled
training document all texts are ``und``; null ids and repeated rows are rows like any other;
further columns are ignored. ``score`` is the margin between the best and the second distance,
divided by the second (1 where there is one language only).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linkspan.llm.common import map_texts, small_batches, table

PROFILE = 400
DOC_GRAMS = 300
#: The bound on the labelled rows that a language's profile is fitted on.
FIT_DOCS = 1500
#: The alphabet's size: letters beyond the most frequent ones share one code.
ALPHABET = 255


def letters(text: str) -> np.ndarray:
    """Code points of the lower-cased letters, with one 32 for what stands between words."""
    low = "".join(c if c.isalpha() else " " for c in text.lower()) if not text.isascii() else text.lower()
    points = np.frombuffer(f" {low} ".encode("utf-32-le"), dtype="<u4").astype(np.int64)
    if text.isascii():
        points = np.where((points >= 97) & (points <= 122), points, 32)
    keep = np.ones(len(points), dtype=bool)
    keep[1:] = (points[1:] != 32) | (points[:-1] != 32)
    return points[keep]


def codes(points: np.ndarray, alphabet: np.ndarray) -> np.ndarray:
    """All 1- to 3-grams as numbers: 0 is the space, len(alphabet) + 1 any letter that the alphabet lacks."""
    at = np.searchsorted(alphabet, points)
    at[at == len(alphabet)] = 0
    one = np.where(alphabet[at] == points, at + 1, len(alphabet) + 1) if len(alphabet) else np.ones_like(points)
    one[points == 32] = 0
    base = np.int64(len(alphabet) + 2)
    two = one[:-1] * base + one[1:]
    three = two[:-1] * base + one[2:]
    return np.concatenate([one[one > 0], base + two, base + base * base + three])


def ranked(grams: np.ndarray, most: int) -> np.ndarray:
    """The most frequent codes by rank; ties by code."""
    grams = np.sort(grams)
    starts = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
    counts = np.diff(np.append(starts, len(grams)))
    order = np.argsort(-counts, kind="stable")[:most]
    return grams[starts][order]


def fit(docs: DataFrame, lang_col: str, text_col: str = "text", limit: int = FIT_DOCS, profile: int = PROFILE) -> dict:
    """Alphabet and profiles from at most `limit` labelled rows of each language; the result's size is fixed by `profile` and `ALPHABET`."""
    labelled = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("h"))
    labelled = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    # hashes are even, so a share of the hash space that holds twice the limit leaves few rows to rank, whatever the size of the input
    sizes = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()}
    if not sizes:
        return {"langs": [], "alphabet": np.zeros(0, np.int64), "profiles": []}
    tops = {lang: min(2**63 - 1, int(2 * (limit + 50) / max(n, 1) * 2**64) - 2**63) for lang, n in sizes.items()}
    cut = F.create_map(*[F.lit(x) for kv in tops.items() for x in kv])
    texts = labelled.where(F.col("h") <= cut[F.col("lang")]).groupBy("lang", "h").agg(F.first("text").alias("text"))
    chosen = texts.withColumn("k", F.row_number().over(W.partitionBy("lang").orderBy("h"))).where(F.col("k") <= limit)

    def counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found: dict[str, Counter] = {}
            for lang, text in zip(pdf["lang"], pdf["text"], strict=True):
                s, c = letters(text).astype("<u4").tobytes().decode("utf-32-le"), found.setdefault(lang, Counter())
                c.update(s)
                c.update(map("".join, zip(s, s[1:], strict=False)))
                c.update(map("".join, zip(s, s[1:], s[2:], strict=False)))
            yield pd.DataFrame([(lang, gram, n) for lang, c in found.items() for gram, n in c.items()], columns=["lang", "gram", "n"])

    small_batches(docs.sparkSession)
    grams = chosen.select("lang", "text").mapInPandas(counts, "lang string, gram string, n long").where(F.col("gram") != " ")
    grams = grams.groupBy("lang", "gram").agg(F.sum("n").alias("n")).persist()
    single = grams.where(F.length("gram") == 1).groupBy("gram").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "gram").limit(ALPHABET).collect()
    top = grams.withColumn("k", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("k") <= profile).orderBy("lang", "k").collect()
    grams.unpersist()
    alphabet = np.array(sorted(ord(r.gram) for r in single), dtype=np.int64)
    langs = sorted({r.lang for r in top})
    profiles = []
    base = len(alphabet) + 2
    index = {int(c): i + 1 for i, c in enumerate(alphabet)}
    for lang in langs:
        out = []
        for r in top:
            if r.lang != lang:
                continue
            ids = [0 if c == " " else index.get(ord(c), len(alphabet) + 1) for c in r.gram]
            out.append(ids[0] if len(ids) == 1 else base + ids[0] * base + ids[1] if len(ids) == 2 else base + base * base + (ids[0] * base + ids[1]) * base + ids[2])
        profiles.append(np.array(list(dict.fromkeys(out)), dtype=np.int64))
    return {"langs": langs, "alphabet": alphabet, "profiles": profiles}


def distances(grams: np.ndarray, profiles: list[tuple[np.ndarray, np.ndarray]], penalty: int) -> np.ndarray:
    """The out-of-place distance of ranked codes to each profile, given as (sorted codes, their ranks)."""
    ranks = np.arange(len(grams))
    out = np.empty(len(profiles))
    for k, (keys, place) in enumerate(profiles):
        at = np.minimum(np.searchsorted(keys, grams), len(keys) - 1)
        hit = keys[at] == grams
        out[k] = np.where(hit, np.abs(place[at] - ranks), penalty).sum()
    return out


def predict(docs: DataFrame, model: dict, text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """`keep` and lang_pred, score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def per_batch():
        m = shared.value
        langs, alphabet = m["langs"], m["alphabet"]
        profiles = [(p[o], o) for p in m["profiles"] for o in [np.argsort(p)]]

        def one(text: str | None) -> tuple[str, float]:
            points = letters(text) if text and langs else np.zeros(0, np.int64)
            if not (points != 32).any():
                return "und", 0.0
            d = distances(ranked(codes(points, alphabet), DOC_GRAMS), profiles, PROFILE)
            best = int(d.argmin())
            second = np.delete(d, best).min() if len(d) > 1 else 0.0
            return langs[best], float((second - d[best]) / second) if second > 0 else 1.0

        def run(texts: list) -> dict[str, list]:
            found = [one(t) for t in texts]
            return {"lang_pred": [x for x, _ in found], "score": [x for _, x in found]}

        return run

    return map_texts(docs, text_col, keep, per_batch, "lang_pred string, score double")


def op6_rank_order_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document; those whose crc32 of the id leaves 2 when divided by 4 are held out of the fitting."""
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    model = fit(docs.where(~held), "lang")
    return predict(docs.select("doc_id", "text", held.alias("held_out")), model, keep=("doc_id", "held_out"))
