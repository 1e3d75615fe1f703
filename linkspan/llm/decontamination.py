"""Benchmark decontamination by template canonicalisation.

Texts and benchmark items become sequences of canonical tokens: words are stripped of punctuation
and lower-cased, and numbers, names and units of measure are replaced with typed placeholders. A
name is a capitalised word within a sentence. Windows of ``WINDOW`` canonical tokens are hashed and
joined; an item shorter than that is one window of its own length, if it has ``SHORTEST`` tokens.
Windows of which less than half is left after the placeholders are no evidence.

Every item has plain windows too, of its words and numbers as they stand, an item of fewer than
``WINDOW`` words being one window whatever its length: copies of items of which the placeholders leave
little, and of short ones, are found by these. An item of one word is found wherever the word stands.
Either kind of windows is judged by itself, and the figures are those of the templates where these
meet the conditions. Plain windows have no slots, so their consistency is 1.

A document leaks an item when at least ``COVERED`` of the item's windows, or ``LONG_RUN`` of them,
are found in it, and the slots agree: each value that a placeholder stands for in the item must be
replaced by one value throughout, and each value in the document must replace one value only, for
``CONSISTENT`` of the slots met. A slot counts once by its place, however many windows cover it. So a
question with its names and numbers exchanged is caught, and a text that merely has the same shape, or
is torn from several variants, is not.

A document may hold an item several times, each time with other values. Both conditions are therefore
asked of the whole document and of each occurrence, and one that meets them is enough: matches at one
distance between their places in the document and in the item, and matches whose distances follow one
another by a quarter of the item at most, as words put in or left out shift them. The figures are the
whole document's where it meets the conditions, else the best occurrence's.

The benchmark's windows are broadcast while they are ``BROADCAST_WINDOWS`` at most (8 bytes each);
beyond, the documents' windows are shuffled to them.

Defined cases: null or empty texts and items leak nothing; null ids and repeated rows are rows like
any other, repeated items are items of their own; ties do not matter, as all leaked items are
reported; further columns are ignored; with either table empty the result is empty.
"""

from __future__ import annotations

import re

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linkspan.llm.common import free_name, map_texts, materialise, numbered, pick, table

WINDOW = 8
SHORTEST = 5
COVERED = 0.5
LONG_RUN = 13
CONSISTENT = 0.8
BROADCAST_WINDOWS = 2_000_000
WORDS_CACHED = 300_000
#: Where the conditions are asked: of the whole document, of one shift against the item, of shifts near one another.
WHOLE, SHIFT, NEAR = 0, 1, 2
#: Units of measure.
UNITS = frozenset(
    "mm cm m km inch inches foot feet ft yard yards mile miles mg g kg gram grams kilogram kilograms ton tons tonne tonnes ounce ounces oz pound pounds lb lbs "
    "ml l litre litres liter liters gallon gallons s sec second seconds min minute minutes h hour hours day days week weeks month months year years "
    "kmh mph hz khz mhz w kw kwh v volt volts degree degrees percent dollar dollars euro euros cent cents usd eur gbp".split()
)
NUMBER = re.compile(r"[+-]?[0-9][0-9.,:/]*")
QUANTITY = re.compile(r"[+-]?[0-9][0-9.,]*([a-z]+)")
ENDS = re.compile(r"[.!?:]\W*\Z")
EDGES = re.compile(r"^[\W_]+|[\W_]+$")
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
#: Added to the length from which a plain window's hash starts: none is taken for a template's.
PLAIN = 1 << 32


def _h(s: str) -> int:
    return xxhash.xxh3_64_intdigest(s.encode("utf-8", "surrogatepass"))


NUMBER_SLOT, NAME_SLOT, UNIT_SLOT, QUANTITY_SLOT = (np.uint64(_h(f"\x00{x}")) for x in ("number", "name", "unit", "quantity"))


class Vocabulary(dict):
    """Word to its number; the words' traits lie in lists by that number."""

    def __init__(self):
        super().__init__()
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.hash, self.plain, self.slot, self.capital, self.ends, self.word = [], [], [], [], [], []

    def __missing__(self, word: str) -> int:
        core = EDGES.sub("", word)
        low = core.lower()
        h, slot = np.uint64(_h(low)), True
        self.plain.append(h)
        if NUMBER.fullmatch(low):
            h = NUMBER_SLOT
        elif low in UNITS:
            h = UNIT_SLOT
        elif (m := QUANTITY.fullmatch(low)) and m[1] in UNITS:
            h = QUANTITY_SLOT
        else:
            slot = False
        self.hash.append(h)
        self.slot.append(slot)
        self.capital.append(not slot and core[:1].isupper() and not core.isupper())
        self.ends.append(bool(ENDS.search(word)))
        self.word.append(low)
        at = self[word] = len(self)
        return at


def canonical(texts: list, vocabulary: Vocabulary, names: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Over all texts in a row: the tokens' hashes, whether each is a slot, its word's number, and each text's end. Without names these are words like any other."""
    if len(vocabulary) > WORDS_CACHED:
        vocabulary.forget()
    get = vocabulary.__getitem__
    lines = [np.fromiter(map(get, t.split()), np.int64) if t else np.zeros(0, np.int64) for t in texts]
    words = np.concatenate(lines) if lines else np.zeros(0, np.int64)
    ends = np.cumsum([len(x) for x in lines])
    h, slot = np.array(vocabulary.hash, np.uint64), np.array(vocabulary.slot, bool)
    capital, closing = np.array(vocabulary.capital, bool), np.array(vocabulary.ends, bool)
    full = np.array([bool(w) for w in vocabulary.word], bool)
    if not len(words):
        return np.zeros(0, np.uint64), np.zeros(0, bool), words, ends
    opens = np.concatenate([[True], closing[words[:-1]]])
    opens[ends[:-1][ends[:-1] < len(words)]] = True
    # what has no letter or digit passes on whether it ended a sentence
    keep = full[words]
    blank = ~keep
    if blank.any():
        after = np.concatenate([[False], blank[:-1]])
        opens |= after
    name = capital[words] & ~opens & names
    tokens = np.where(name, NAME_SLOT, h[words])
    slots = slot[words] | name
    counts = np.concatenate([[0], np.cumsum(keep)])
    return tokens[keep], slots[keep], words[keep], counts[ends]


def windows(tokens: np.ndarray, slots: np.ndarray | None, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Each window's hash, and whether it counts: it lies within one text and half of it or more are words. Without slots the tokens are plain."""
    n = len(tokens) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    h = np.full(n, np.uint64(length if slots is not None else PLAIN + length))
    few = np.zeros(n, np.int64)
    for k in range(length):
        h = (h ^ tokens[k : k + n]) * MULTIPLIER
        h ^= h >> np.uint64(29)
        if slots is not None:
            few += slots[k : k + n]
    text = np.repeat(np.arange(len(ends)), np.diff(np.concatenate([[0], ends])))
    return h, (text[:n] == text[length - 1 :]) & (2 * few <= length)


def _slot_places(slots: np.ndarray, at: int, length: int) -> list[int]:
    return np.flatnonzero(slots[at : at + length]).tolist()


def _slot_words(slots: np.ndarray, words: np.ndarray, at: int, length: int, vocabulary: Vocabulary) -> list[str]:
    return [vocabulary.word[w] for w, s in zip(words[at : at + length], slots[at : at + length], strict=True) if s]


def _all_windows(text: str | None, vocabulary: Vocabulary) -> list[tuple[int, int, int, list[str], list[int]]]:
    """(hash, place, length, slot words, their places in the window) of an item's template windows, each with its names as slots and as words: texts in one case show no names."""
    out: dict[tuple[int, int], tuple] = {}
    for names in (True, False):
        tokens, slots, words, ends = canonical([text], vocabulary, names)
        length = min(WINDOW, len(tokens))
        if length < SHORTEST:
            return []
        h, counts = windows(tokens, slots, ends, length)
        for i, (x, c) in enumerate(zip(h.view(np.int64).tolist(), counts, strict=True)):
            if c:
                out.setdefault((x, i), (x, i, length, _slot_words(slots, words, i, length, vocabulary), _slot_places(slots, i, length)))
    return list(out.values())


def _plain_windows(text: str | None, vocabulary: Vocabulary) -> list[tuple[int, int, int]]:
    """(hash, place, length) of an item's plain windows."""
    _, _, words, ends = canonical([text], vocabulary)
    length = min(WINDOW, len(words))
    if not length:
        return []
    h, _ = windows(np.array(vocabulary.plain, np.uint64)[words], None, ends, length)
    return [(x, i, length) for i, x in enumerate(h.view(np.int64).tolist())]


WINDOW_TYPE = "array<struct<h:bigint,at:int,len:int,plain:boolean,slots:array<string>>>"
ITEM_TYPE = WINDOW_TYPE.replace(">>>", ">,places:array<int>>>")


def _item_windows():
    vocabulary = Vocabulary()

    def run(texts: list) -> dict[str, list]:
        template = [[{"h": h, "at": i, "len": n, "plain": False, "slots": s, "places": p} for h, i, n, s, p in _all_windows(t, vocabulary)] for t in texts]
        plain = [[{"h": h, "at": i, "len": n, "plain": True, "slots": [], "places": []} for h, i, n in _plain_windows(t, vocabulary)] for t in texts]
        return {"w": template, "p": plain}

    return run


def _document_windows(lengths: list[tuple[bool, int]], wanted):
    """The windows that the benchmark has, or all where wanted is None."""

    def per_batch():
        vocabulary = Vocabulary()
        known = wanted.value if wanted is not None else None
        if known is not None:
            sieve = np.zeros(1 << 22, bool)
            sieve[(known >> np.uint64(42)).astype(np.int64)] = True

        def run(texts: list) -> dict[str, list]:
            tokens, slots, words, ends = canonical(texts, vocabulary)
            out: list[list] = [[] for _ in texts]
            as_they_stand = np.array(vocabulary.plain, np.uint64)[words]
            starts = np.concatenate([[0], ends])
            for plain, length in lengths:
                h, counts = windows(as_they_stand, None, ends, length) if plain else windows(tokens, slots, ends, length)
                if known is not None:
                    hit = np.flatnonzero(counts & sieve[(h >> np.uint64(42)).astype(np.int64)])
                    at = np.minimum(np.searchsorted(known, h[hit]), len(known) - 1)
                    hit = hit[known[at] == h[hit]]
                else:
                    hit = np.flatnonzero(counts)
                text = np.searchsorted(ends, hit, side="right")
                for i, t in zip(hit.tolist(), text.tolist(), strict=True):
                    out[t].append({"h": int(h[i : i + 1].view(np.int64)[0]), "at": i - int(starts[t]), "len": length, "plain": plain, "slots": [] if plain else _slot_words(slots, words, i, length, vocabulary)})
            return {"w": out}

        return run

    return per_batch


def _occurrences(met: DataFrame) -> DataFrame:
    """Each match once for its document, once for its own shift, and once for the shifts near one another, as `scope`."""
    own = ["uid", "item", "plain"]
    shifts = met.select(*own, "tokens", "shift").distinct()
    by_shift = W.partitionBy(*own).orderBy("shift")
    apart = F.coalesce((4 * (F.col("shift") - F.lag("shift").over(by_shift)) > F.col("tokens")).cast("int"), F.lit(0))
    near = shifts.withColumn("apart", apart).select(*own, "shift", F.sum("apart").over(by_shift).cast("int").alias("near"))
    scopes = ((WHOLE, F.lit(0)), (SHIFT, F.col("shift")), (NEAR, F.col("near")))
    scope = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), n.cast("int").alias("n")) for k, n in scopes)))
    return met.join(near, [*own, "shift"]).withColumn("scope", scope)


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, its row number `uid`, item_id, n_windows of the item, n_matched of them and consistency, for each document and item that it leaks."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text).alias("text"), F.monotonically_increasing_id().alias("item"))
    items = map_texts(items, "text", ("item_id", "item"), _item_windows, f"w {ITEM_TYPE}, p {ITEM_TYPE}")
    items = items.select("item_id", "item", F.explode(F.array("w", "p")).alias("w"))
    n_windows = F.size(F.array_distinct(F.transform("w", lambda x: x["at"])))
    tokens = F.array_max(F.transform("w", lambda x: x["at"] + x["len"]))
    items = materialise(items.select("item_id", "item", n_windows.alias("n_windows"), tokens.alias("tokens"), F.explode("w").alias("w")).select("item_id", "item", "n_windows", "tokens", "w.*"))
    lengths = sorted((r.plain, r.len) for r in items.select("plain", "len").distinct().collect())
    known = items.select("h").distinct()
    wanted = None
    if known.count() <= BROADCAST_WINDOWS:
        wanted = spark.sparkContext.broadcast(np.unique(known.toArrow()["h"].to_numpy().view(np.uint64)))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("uid"))
    if not lengths:
        rows, lengths, wanted = rows.limit(0), [(False, WINDOW)], None
    found = map_texts(rows, "text", ("doc_id", "uid"), _document_windows(lengths, wanted), f"w {WINDOW_TYPE}")
    found = found.where(F.size("w") > 0).select("doc_id", "uid", F.explode("w").alias("w")).select("doc_id", "uid", F.col("w.h").alias("h"), F.col("w.at").alias("at"), F.col("w.slots").alias("slots"))
    met = found.join(items.select("item_id", "item", "n_windows", "tokens", "plain", F.col("at").alias("place"), "h", F.col("slots").alias("item_slots"), "places"), "h")
    met = materialise(met.withColumn("shift", F.col("at") - F.col("place")))
    if wanted is not None:
        wanted.destroy()
    met = _occurrences(met)
    one = ["uid", "item", "plain", "scope"]
    matched = met.groupBy(*one).agg(F.first("doc_id").alias("doc_id"), F.first("item_id").alias("item_id"), F.first("n_windows").alias("n_windows"), F.count_distinct("place").cast("int").alias("n_matched"))
    matched = matched.where((F.col("n_matched") >= COVERED * F.col("n_windows")) | (F.col("n_matched") >= LONG_RUN))
    slots = met.where(F.size("item_slots") > 0).select(*one, "at", "place", F.explode(F.arrays_zip("item_slots", "slots", "places")).alias("s"))
    slots = slots.select(*one, (F.col("at") + F.col("s.places")).alias("here"), (F.col("place") + F.col("s.places")).alias("there"), "s.item_slots", "s.slots").distinct()
    values = slots.groupBy(*one, "item_slots", "slots").agg(F.count(F.lit(1)).alias("n"))
    ways = []
    for name, side in (("forth", "item_slots"), ("back", "slots")):
        each = values.groupBy(*one, side).agg(F.max("n").alias("best"), F.sum("n").alias("n"))
        ways.append(each.groupBy(*one).agg((F.sum("best") / F.sum("n")).alias(name)))
    agreed = ways[0].join(ways[1], one).select(*one, F.least("forth", "back").alias("consistency"))
    out = matched.join(agreed, one, "left").withColumn("consistency", F.coalesce("consistency", F.lit(1.0))).where(F.col("consistency") >= CONSISTENT)
    figures = F.struct("doc_id", "item_id", "n_windows", "n_matched", "consistency")
    order = F.struct(~F.col("plain"), F.col("scope.kind") == WHOLE, "n_matched", "consistency")
    best = out.groupBy("uid", "item").agg(F.max_by(figures, order).alias("x"))
    return best.select("x.doc_id", "uid", "x.item_id", "x.n_windows", "x.n_matched", "x.consistency")


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """docs without the rows that leak an item."""
    uid = free_name(docs, "row_uid")
    fixed = numbered(docs, uid)
    found = leaks(fixed.select(F.col(uid).alias("id_"), F.col(text_col).alias("text_")), benchmark, "id_", "text_")
    gone = materialise(found.select(F.col("doc_id").alias(uid)).distinct())
    return pick(fixed, gone, uid, "left_anti").select(*docs.columns)


def op5_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item that it leaks."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("uid")
