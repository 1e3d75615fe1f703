"""Language-model scoring by cross-entropy difference.

Two word bigram models of one form and one vocabulary are estimated: the target model on the rows
that labels call good, the background model on all rows. The vocabulary is the words with
``MIN_WORD`` occurrences or more in the target, all others being one unknown word, and the bigrams
with ``MIN_BIGRAM`` or more there; both models know exactly these. With c the counts and beta
``PRIOR``,

    p(w)   = (c(w) + 1) / (N + |V| + 1)            for each word of the vocabulary and the unknown one
    p(w|v) = (c(v w) + (beta + r(v)) p(w)) / (c(v) + beta)  where c(v w) is 0 for bigrams outside the vocabulary

and a text's first word has p(w). r(v) is the count of v that no known bigram takes up, in the same
model: what was left out goes back to the words, so both models sum to one after every word. Without
it (``hand_back`` false) the larger corpus loses most, and texts unlike the target look closest. A row's losses are the mean of -ln p over its words; its score is
the target's loss minus the background's: the lower, the closer to the target.

The vocabulary grows with the corpus. Up to ``BROADCAST_GRAMS`` words and bigrams (24 bytes each)
are broadcast, so texts are scored where they are read. Beyond, a loss is taken apart: p(w|v) of an
unknown bigram is a factor of v times p(w), so a text's loss is that of as many unknown words, and
an effect of each known word, as itself and as the word before, and of each known bigram. The effects
of the most frequent are broadcast; only occurrences of the rare ones, which bitmaps tell from unknown
ones (but for some, which then find nothing), are shuffled to their effects, in ``RARE_PARTS`` parts of
the rows. Both ways give the same scores, up to rounding. Words are told apart by 64-bit hashes of their
bytes, A-Z lower-cased; words and bigrams share one space of hashes.

Defined cases: a null text, or one without words, has n_tokens 0 and null losses and score; without
a target row every word is unknown and the models differ by their totals alone; null ids and
repeated rows are rows like any other; labels may repeat (any good one counts) and need not cover
all rows; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkspan.llm.common import discard, map_texts, materialise, numbered, small_batches, table
from linkspan.llm.ngram_join import MULTIPLIERS, WordHashes, mixed

MIN_WORD = 2
MIN_BIGRAM = 3
PRIOR = 5.0
BROADCAST_GRAMS = 4_000_000
BROADCAST_IDS = 2_000_000
#: Beyond BROADCAST_GRAMS: the part of these that is broadcast as frequent, bits of a bitmap for each key and at most (as powers of two; at most 64 MB), and parts of the rows.
FREQUENT = 4
KEY_BITS, MOST_BITS = 3, 29
RARE_PARTS = 4
#: Counts that a task gathers before it hands them on.
PENDING = 2_000_000
TOTAL, WORD, BIGRAM, BEFORE = 0, 1, 2, 3


def words(text: str | None, hashes: WordHashes) -> np.ndarray:
    parts = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    return np.fromiter(map(hashes.__getitem__, parts), np.uint64, len(parts))


def bigrams(h: np.ndarray) -> np.ndarray:
    return mixed(h[:-1] * MULTIPLIERS[0] + h[1:] * MULTIPLIERS[1])


class Tally:
    """Sums of counts by key, merged as they come."""

    def __init__(self):
        self.keys, self.sums, self.pending = [], [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> bool:
        """Whether it is time to hand the sums on."""
        self.keys.append(keys)
        self.sums.append(counts)
        self.pending += len(keys)
        return self.pending > PENDING

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        keys = np.concatenate(self.keys) if self.keys else np.zeros(0, np.uint64)
        sums = np.concatenate(self.sums) if self.sums else np.zeros((0, 2), np.int64)
        self.__init__()
        own, at = np.unique(keys, return_inverse=True)
        return own, np.stack([np.bincount(at, weights=sums[:, k], minlength=len(own)) for k in (0, 1)], axis=1).astype(np.int64)


def _counted(keys: list[np.ndarray], good: list[bool]) -> tuple[np.ndarray, np.ndarray]:
    every = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
    flag = np.repeat(np.array(good, bool), [len(k) for k in keys])
    own, at = np.unique(every, return_inverse=True)
    return own, np.stack([np.bincount(at[flag], minlength=len(own)), np.bincount(at, minlength=len(own))], axis=1)


def _out(kind: int, keys: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys.view(np.int64)), pa.array(sums[:, 0]), pa.array(sums[:, 1])], names=["kind", "key", "t", "b"])


def _count(rows: DataFrame, known=None) -> DataFrame:
    """kind, key and the counts t (target) and b (all rows), from rows (text, good); of the known bigrams only, where these are given, and then of the words before them too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        tallies = {WORD: Tally(), BIGRAM: Tally(), BEFORE: Tally()}
        total = np.zeros((1, 2), np.int64)
        for batch in batches:
            good = batch.column("good").to_pylist()
            texts = [words(t, hashes) for t in batch.column("text").to_pylist()]
            found = []
            if known is None:
                found.append((WORD, *_counted(texts, good)))
                found.append((BIGRAM, *_counted([bigrams(h) for h, g in zip(texts, good, strict=True) if g], [True] * sum(good))))
                total += [sum(len(h) for h, g in zip(texts, good, strict=True) if g), sum(map(len, texts))]
            else:
                own, n = _counted([bigrams(h) for h in texts], good)
                at = np.minimum(np.searchsorted(known.value, own), max(len(known.value) - 1, 0))
                hit = known.value[at] == own if len(known.value) else np.zeros(len(own), bool)
                own, n = own[hit], n[hit]
                every, before = np.concatenate([bigrams(h) for h in texts]), np.concatenate([h[:-1] for h in texts])
                seen, place = np.unique(every, return_index=True)
                found += [(BEFORE, before[place[np.searchsorted(seen, own)]], n), (BIGRAM, own, n)]
            for kind, own, n in found:
                if tallies[kind].add(own, n):
                    yield _out(kind, *tallies[kind].take())
        for kind, tally in tallies.items():
            yield _out(kind, *tally.take())
        yield _out(TOTAL, np.zeros(1, np.uint64), total)

    small_batches(rows.sparkSession)
    return rows.select("text", "good").mapInArrow(run, "kind int, key long, t long, b long").groupBy("kind", "key").agg(F.sum("t").alias("t"), F.sum("b").alias("b"))


def _by_key(counts: DataFrame) -> dict[str, np.ndarray]:
    """key, t and b as arrays by ascending key; the rows come as Arrow, 24 bytes each."""
    found = counts.toArrow()
    key = found["key"].to_numpy().view(np.uint64)
    order = np.argsort(key)
    return {"key": key[order], "t": found["t"].to_numpy()[order], "b": found["b"].to_numpy()[order]}


def _score_here(model):
    """Losses of texts by tables at hand."""

    def per_batch():
        m = model.value
        hashes = WordHashes()
        sieve = np.zeros(1 << 22, bool)
        sieve[(m["bigrams"] >> np.uint64(42)).astype(np.int64)] = True

        def run(texts: list) -> dict[str, list]:
            lines = [words(t, hashes) for t in texts]
            sizes = np.array([len(x) for x in lines], np.int64)
            h = np.concatenate(lines) if lines else np.zeros(0, np.uint64)
            size = len(m["words"])
            own, back = np.unique(h, return_inverse=True)
            at = np.searchsorted(m["words"], own)
            at[at == size] = 0
            at = np.where(m["words"][at] == own, at, size)[back] if size else np.zeros(len(h), np.int64)
            first = np.zeros(len(h), bool)
            first[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
            pair = np.full(len(h), len(m["bigrams"]), np.int64)
            if len(h) > 1 and len(m["bigrams"]):
                keys = bigrams(h)
                hit = np.flatnonzero(sieve[(keys >> np.uint64(42)).astype(np.int64)] & ~first[1:])
                place = np.minimum(np.searchsorted(m["bigrams"], keys[hit]), len(m["bigrams"]) - 1)
                same = m["bigrams"][place] == keys[hit]
                pair[hit[same] + 1] = place[same]
            out = {"n_tokens": sizes.tolist()}
            text = np.repeat(np.arange(len(sizes)), sizes)
            for k, name in enumerate(("target_loss", "background_loss")):
                p = m["p"][k][at]
                before = np.concatenate([[size], at[:-1]]) if len(at) else at
                given = (m["pair"][k][pair] + (PRIOR + m["rest"][k][before]) * p) / (m["count"][k][before] + PRIOR)
                loss = np.bincount(text, weights=-np.log(np.where(first, p, given)), minlength=len(sizes))
                out[name] = [x / n if n else None for x, n in zip(loss.tolist(), out["n_tokens"], strict=True)]
            return out

        return run

    return per_batch


def _sieve(keys: DataFrame, n: int) -> np.ndarray:
    """A bitmap of the first bits of n keys, made where the keys are; it may hold keys that are none of them."""
    bits = min(MOST_BITS, max(15, int(n).bit_length() + KEY_BITS))
    place = F.shiftrightunsigned("key", 64 - bits)
    told = keys.select(F.shiftright(place, 15).alias("page"), place.bitwiseAND(F.lit(32767)).alias("bit")).repartition("page").groupBy("page").agg(F.bitmap_construct_agg("bit").alias("bitmap"))
    out = np.zeros((1 << bits - 15, 4096), np.uint8)
    for batch in told.toArrow().to_batches():
        for page, bitmap in zip(batch["page"].to_pylist(), batch["bitmap"].to_pylist(), strict=True):
            out[page] = np.frombuffer(bitmap, np.uint8)
    return out.reshape(-1)


def _passes(sieve: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = keys >> np.uint64(64 - (8 * len(sieve)).bit_length() + 1)
    return (sieve[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def _count_passing(rows: DataFrame, sieve) -> DataFrame:
    """key, v, w and the counts t and b of the bigrams that pass the sieve, from rows (text, good)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        found: list[tuple] = []

        def merged() -> pa.RecordBatch:
            key, v, w, t, b = (np.concatenate(x) for x in zip(*found, strict=True))
            own, first, at = np.unique(key, return_index=True, return_inverse=True)
            sums = [np.bincount(at, weights=x, minlength=len(own)).astype(np.int64) for x in (t, b)]
            found.clear()
            return pa.RecordBatch.from_arrays([*(pa.array(x.view(np.int64)) for x in (own, v[first], w[first])), *map(pa.array, sums)], names=["key", "v", "w", "t", "b"])

        for batch in batches:
            texts = [words(x, hashes) for x in batch.column("text").to_pylist()]
            if texts:
                key, v, w = (np.concatenate([f(h) for h in texts]) for f in (bigrams, lambda h: h[:-1], lambda h: h[1:]))
                flag = np.repeat(np.array(batch.column("good").to_pylist(), bool), [max(len(h) - 1, 0) for h in texts])
                hit = _passes(sieve.value, key)
                own, first, at, n = np.unique(key[hit], return_index=True, return_inverse=True, return_counts=True)
                found.append((own, v[hit][first], w[hit][first], np.bincount(at[flag[hit]], minlength=len(own)), n))
                if sum(len(x[0]) for x in found) > PENDING:
                    yield merged()
        if found:
            yield merged()

    small_batches(rows.sparkSession)
    counts = rows.select("text", "good").mapInArrow(run, "key long, v long, w long, t long, b long")
    return counts.groupBy("key").agg(F.min("v").alias("v"), F.min("w").alias("w"), F.sum("t").alias("t"), F.sum("b").alias("b"))


def _base_losses(model):
    """Sums of texts' losses by the effects at hand, and the occurrences of what may be rare: keys, and how often each is there (words: as themselves) and is the word before."""

    def per_batch():
        m = model.value
        hashes = WordHashes()
        size = len(m["keys"])
        near = np.zeros(1 << 22, bool)
        near[(m["keys"] >> np.uint64(42)).astype(np.int64)] = True

        def place_of(keys: np.ndarray) -> np.ndarray:
            """Where the effects of keys are, the last place if they are not at hand."""
            out = np.full(len(keys), size)
            hit = np.flatnonzero(near[(keys >> np.uint64(42)).astype(np.int64)])
            if size:
                at = np.minimum(np.searchsorted(m["keys"], keys[hit]), size - 1)
                out[hit] = np.where(m["keys"][at] == keys[hit], at, size)
            return out

        def run(texts: list) -> dict[str, list]:
            lines = [words(t, hashes) for t in texts]
            sizes = np.array([len(x) for x in lines], np.int64)
            h = np.concatenate(lines) if lines else np.zeros(0, np.uint64)
            text = np.repeat(np.arange(len(sizes)), sizes)
            inner = np.flatnonzero(text[:-1] == text[1:])  # words that are before another
            every = np.concatenate([h, bigrams(h)[inner]])
            of = np.concatenate([text, text[inner]])
            some, again = np.unique(h, return_inverse=True)
            at = np.concatenate([place_of(some)[again], place_of(every[len(h) :])])
            rare = np.flatnonzero((at == size) & np.concatenate([_passes(m["sieve"], some)[again], _passes(m["sieve"], every[len(h) :])]))
            out = {"n_tokens": sizes.tolist()}
            for k, name in enumerate(("target_sum", "background_sum")):
                loss = np.bincount(of, weights=m["own"][k][at], minlength=len(sizes)) + np.bincount(text[inner], weights=m["before"][k][at[inner]], minlength=len(sizes))
                out[name] = (loss + sizes * m["unknown"][k] + np.maximum(sizes - 1, 0) * m["unknown_before"][k]).tolist()
            own, back = np.unique(every[rare], return_inverse=True)
            before = np.zeros(len(every), bool)
            before[inner] = True
            place, as_it, n = np.unique(of[rare] * max(len(own), 1) + back, return_inverse=True, return_counts=True)
            cuts = np.searchsorted(place, np.arange(1, len(sizes)) * max(len(own), 1))
            parts = {"keys": own.view(np.int64)[place % max(len(own), 1)], "n": n.astype(np.int32), "n_before": np.bincount(as_it, weights=before[rare], minlength=len(place)).astype(np.int32)}
            return out | {name: np.split(x, cuts) if len(sizes) else [] for name, x in parts.items()}

        return run

    return per_batch


def _score_beyond(rows: DataFrame, flagged: DataFrame, vocabulary: DataFrame, inventory: DataFrame, size: int, grams: int, total: list[int], unknown: list[int], frequent: int, hand_back: bool) -> DataFrame:
    """doc_id, n_tokens and both losses by a model that is too large to broadcast."""
    spark = rows.sparkSession
    sieve = spark.sparkContext.broadcast(_sieve(inventory, grams))
    known = materialise(_count_passing(flagged, sieve).join(inventory.select("key"), "key", "left_semi"))
    sieve.destroy()
    taken = known.groupBy("v").agg(F.sum("t").alias("taken_t"), F.sum("b").alias("taken_b"))
    each = vocabulary.join(taken, F.col("key") == F.col("v"), "left")

    def parts(k: int, name: str) -> list[Column]:
        """p(w), and what p(w|v) is beside it for unknown bigrams, times c(v) + beta."""
        rest = F.col(name) - F.coalesce(f"taken_{name}", F.lit(0)) if hand_back else F.lit(0)
        return [((F.col(name) + 1) / F.lit(float(total[k] + size + 1))).alias(f"p_{name}"), (PRIOR + rest).cast("double").alias(f"r_{name}")]

    each = materialise(each.select("key", "t", "b", *(c for k, name in enumerate("tb") for c in parts(k, name))))
    p_unknown = [(unknown[k] + 1) / (total[k] + size + 1) for k in (0, 1)]
    lost = [float(-np.log(p)) for p in p_unknown]
    lost_before = [float(-np.log((PRIOR + (c if hand_back else 0)) / (c + PRIOR))) for c in unknown]
    of_words = [-F.log(F.col(f"p_{name}")) - lost[k] for k, name in enumerate("tb")] + [-F.log(F.col(f"r_{name}") / (F.col(name) + PRIOR)) - lost_before[k] for k, name in enumerate("tb")]
    names = ("own_t", "own_b", "before_t", "before_b")
    word_effects = each.select("key", "b", *(c.alias(x) for c, x in zip(of_words, names, strict=True)))
    v, w = each.select(F.col("key").alias("v"), "r_t", "r_b"), each.select(F.col("key").alias("w"), "p_t", "p_b")
    of_grams = [-F.log1p(F.col(name) / (F.col(f"r_{name}") * F.col(f"p_{name}"))) for name in "tb"] + [F.lit(0.0)] * 2
    effects = materialise(word_effects.unionByName(known.join(v, "v").join(w, "w").select("key", "b", *(c.alias(x) for c, x in zip(of_grams, names, strict=True)))))
    discard(known, each)

    step = F.floor(4 * F.log2("b"))
    held, least, last = 0, None, 0
    for r in effects.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():
        last += r["count"]
        if held == last - r["count"] and last <= frequent:
            held, least = last, r.step
    top = effects.where(step >= least if least is not None else F.lit(False)).toArrow()
    rare = effects.where(step < least if least is not None else F.lit(True)).select("key", *names)
    key = top["key"].to_numpy().view(np.uint64)
    order = np.argsort(key)
    model = {"keys": key[order], "sieve": _sieve(rare, last - held), "unknown": lost, "unknown_before": lost_before}
    model |= {x: [np.append(top[f"{x}_{name}"].to_numpy()[order], 0.0) for name in "tb"] for x in ("own", "before")}
    shared = spark.sparkContext.broadcast(model)
    schema = "n_tokens long, target_sum double, background_sum double, keys array<bigint>, n array<int>, n_before array<int>"
    scored = materialise(map_texts(rows, "text", ("doc_id", "uid"), _base_losses(shared), schema))
    shared.destroy()
    found = []
    for k in range(RARE_PARTS):
        part = scored.where(F.pmod(F.xxhash64("uid"), F.lit(RARE_PARTS)) == k).select("uid", F.explode(F.arrays_zip("keys", "n", "n_before")).alias("x"))
        part = part.select("uid", F.col("x.keys").alias("key"), "x.n", "x.n_before").join(rare, "key")
        more = (F.sum(F.col("n") * F.col(f"own_{x}") + F.col("n_before") * F.col(f"before_{x}")).alias(f"more_{x}") for x in "tb")
        found.append(materialise(part.groupBy("uid").agg(*more)))
    discard(effects)
    out = scored.select("doc_id", "uid", "n_tokens", "target_sum", "background_sum").join(reduce(DataFrame.unionByName, found), "uid", "left")
    mean = lambda whole, x: F.when(F.col("n_tokens") > 0, (F.col(whole) + F.coalesce(f"more_{x}", F.lit(0.0))) / F.col("n_tokens"))
    return out.select("doc_id", "n_tokens", mean("target_sum", "t").alias("target_loss"), mean("background_sum", "b").alias("background_loss"))


def score(docs: DataFrame, good_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_grams: int = BROADCAST_GRAMS, hand_back: bool = False) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss and score of every row; good_ids has one column of ids. hand_back: whether counts of unknown bigrams go back to the words."""
    spark = docs.sparkSession
    good = good_ids.select(F.col(good_ids.columns[0]).alias("good_id")).where("good_id is not null").distinct()
    side = F.broadcast(good) if good.count() <= BROADCAST_IDS else good
    rows = numbered(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "uid")
    flagged = rows.join(side, rows["doc_id"] == F.col("good_id"), "left").select("doc_id", "uid", "text", F.col("good_id").isNotNull().alias("good"))
    counts = _count(flagged)
    kept = materialise(counts.where((F.col("kind") == TOTAL) | ((F.col("kind") == WORD) & (F.col("t") >= MIN_WORD)) | ((F.col("kind") == BIGRAM) & (F.col("t") >= MIN_BIGRAM))))
    vocabulary = kept.where(F.col("kind") == WORD)
    inventory = kept.where(F.col("kind") == BIGRAM)
    sums = {r.kind: r for r in kept.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("t").alias("t"), F.sum("b").alias("b")).collect()}
    size, total = (sums[WORD].n if WORD in sums else 0), [sums[TOTAL].t, sums[TOTAL].b] if TOTAL in sums else [0, 0]
    unknown = [n - (getattr(sums[WORD], k) if WORD in sums else 0) for k, n in zip("tb", total, strict=True)]
    here = size + (sums[BIGRAM].n if BIGRAM in sums else 0) <= broadcast_grams
    if here:
        v = _by_key(vocabulary.select("key", "t", "b"))
        known = spark.sparkContext.broadcast(np.unique(inventory.select("key").toArrow()["key"].to_numpy().view(np.uint64)))
        met = materialise(_count(flagged, known).where(F.col("kind") != TOTAL))
        known.destroy()
        i, before = (_by_key(met.where(F.col("kind") == kind).select("key", "t", "b")) for kind in (BIGRAM, BEFORE))
        place = np.searchsorted(v["key"], before["key"])  # a known bigram's words are known
        model = {"words": v["key"], "bigrams": i["key"], "p": [], "count": [], "pair": [], "rest": []}
        for k, name in enumerate("tb"):
            count = np.append(v[name].astype(np.float64), unknown[k])
            model["count"].append(count)
            model["p"].append((count + 1) / (total[k] + size + 1))
            model["pair"].append(np.append(i[name].astype(np.float64), 0.0))
            rest = count.copy() if hand_back else np.zeros(size + 1)
            if hand_back:
                rest[place] -= before[name]
            model["rest"].append(rest)
        out = map_texts(rows, "text", ("doc_id",), _score_here(spark.sparkContext.broadcast(model)), "n_tokens long, target_loss double, background_loss double")
    else:
        out = _score_beyond(rows, flagged, vocabulary, inventory.select("key"), size, sums[BIGRAM].n if BIGRAM in sums else 0, total, unknown, broadcast_grams // FREQUENT, hand_back)
    return out.withColumn("score", F.col("target_loss") - F.col("background_loss"))


def op7_cross_entropy_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of every document; the target is the documents that labels call good and not toxic."""
    labels = table(spark, sf_dir, "labels").where("quality = 1 and coalesce(toxic, 0) = 0").select("doc_id")
    return score(table(spark, sf_dir, "documents"), labels, hand_back=True)
