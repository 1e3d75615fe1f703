"""Similarity join on word shingles by multiple-global-order prefix filtering.

Sets of word shingles link at a Jaccard similarity of ``percent`` or more; width and similarity are
parameters (five words and 80 for near duplicates, three and 90 for the query). Under any fixed order
of all shingles, two sets that link share a shingle among the first ``n - ceil(t n) + 1`` of each.
Three orders are used. All put shingles that are frequent in the corpus last, by frequency; the
rest follow in three unrelated orders by hash. The first order's prefixes are longer by a tenth of the
set, so sets that link share about as many shingles there: sets that hold too few shingles found in
any other prefix link with nothing and go at once. The rest that share a prefix shingle under the
first order are candidates; candidates must also share one under the second and the third, fit in size,
and not differ in more bits of a 512-bit parity sketch than the similarity allows. What passes all
filters is verified on the whole sets. None of the filters can lose a link.

Equal sets are joined through their digest and stand in for one another afterwards. Only the
components are wanted, so no bucket is expanded into all its pairs. In each of ``STARS`` rounds every
bucket that still holds several components has a lead, another one each time, and each set is held
against one lead of another component: that with which it shares most. Then only pairs from components
that are still different are left. They meet in the shorter prefixes (one shared shingle is enough
there), each pair at the least shingle that it shares, and pass the filters inside the join, before they
become rows. A bucket is first dealt into chance groups of about ``FIRST_PART`` sets, all pairs of a group
meet, and what links is one component; then into groups ``WIDER`` times as large, and so on. Whatever
part of a large group of near copies links, each round makes but a few rows a set: once groups are large
enough for a set to find some links, most sets are in one component, and their pairs are no longer made. A bucket
that is one group is done, most of them in the first round; one of more than ``BLOCK`` sets is dealt out by pairs of
blocks in the end, and there only sets outside its largest component look for others.

The frequent shingles are counted over all rows, within batches first; at most ``HEAVY`` of them are
broadcast (16 bytes each). Which they are touches the speed alone: any order gives the same links.
Shingles are 64-bit hashes; the filters look at 48 and at 31 bits of them, which may only let more
pairs through to the verification.

Defined cases: null texts and texts without words have no shingles and link with nothing, not even
each other; a text of fewer words than a shingle has is one shingle; null ids take part, and a component's id is
its smallest id that is not null (null if there is none); repeated rows are equal sets; further
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkspan.llm.common import discard, free_name, map_texts, materialise, numbered, pick, table
from linkspan.llm.graph import components

#: Words of a shingle, and the similarity from which sets link: of the query, and of near duplicates.
WORDS, PERCENT = 3, 90
NEAR_WORDS, NEAR_PERCENT = 5, 80
#: Rounds in which sets are held against leads; members of the first groups of a bucket, and how many times as large the next are; members from which a bucket is dealt out by pairs of blocks.
STARS = 1
FIRST_PART = 16
WIDER = 8
BLOCK = 1000
#: Tokens that a set carries into its buckets, so that it meets another in one of them only. One that has more carries the least FEW of them, and meets in all buckets only those sets that carry none of these.
CARRIED = 256
FEW = 32
#: Parts, by token, in which it is found which prefix shingles sets share: the shuffle files of one part are on disk at a time.
TOKEN_PARTS = 4
#: The most frequent shingles that the orders know, and the count in a batch of rows from which a shingle is counted.
HEAVY = 200_000
BATCH_COUNT = 3
SKETCH = 8
MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64)
WORDS_CACHED = 150_000


class WordHashes(dict):
    """64-bit hashes of words, kept for the words to come."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_CACHED:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * MULTIPLIERS[3]
    return h ^ (h >> np.uint64(29))


def places(width: int) -> list[np.uint64]:
    """A factor for each place in a shingle: the powers of an odd number."""
    return [np.uint64(pow(int(MULTIPLIERS[0]), k + 1, 1 << 64)) for k in range(width)]


def shingles(text: str | None, hashes: WordHashes, width: int = WORDS) -> np.ndarray:
    """The distinct shingles' hashes, ascending."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    if len(h) < width:
        return mixed((h * np.array(places(len(h)))).sum(keepdims=True, dtype=np.uint64) + np.uint64(len(h)))
    n = len(h) - width + 1
    out = np.zeros(n, np.uint64)
    for k, m in enumerate(places(width)):
        out += h[k : k + n] * m
    return np.unique(mixed(out))


def prefix_size(n: int, percent: int, shared: int = 1) -> int:
    """Members of a set of n that come first in an order and hold `shared` members of any set that it links with, these being first there too."""
    return n - (percent * n + 99) // 100 + shared


def shared_size(n: int) -> int:
    """How many shared prefix shingles the first order looks for: a tenth of the set and one."""
    return 1 + n // 10


def _first_pass(width: int):
    """Each set's size and digest, and a batch's frequent shingles."""

    def per_batch():
        hashes = WordHashes()
        return lambda texts: _sizes([shingles(t, hashes, width) for t in texts])

    def _sizes(sets: list[np.ndarray]) -> dict[str, list]:
        found, counts = np.unique(np.concatenate(sets), return_counts=True) if sets else (np.zeros(0, np.uint64), np.zeros(0, int))
        many = counts >= BATCH_COUNT
        rest = [None] * (len(sets) - 1)
        return {
            "n": [len(s) for s in sets],
            "digest": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets],
            "heavy": [found[many].view(np.int64).tolist(), *rest],
            "heavy_n": [counts[many].tolist(), *rest],
        }

    return per_batch


def _ordered(s: np.ndarray, keys: np.ndarray, places: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The rare shingles by hash, and the frequent ones by frequency as far as `most` members reach them."""
    if not len(keys):
        return s, s[:0]
    at = np.minimum(np.searchsorted(keys, s), len(keys) - 1)
    hit = keys[at] == s
    rare, often = s[~hit], s[hit]
    if len(rare) < most:
        often = often[np.argsort(places[at[hit]], kind="stable")]
    return rare, often


def _first_prefixes(heavy, percent: int, width: int):
    """Each set's prefix under the first order, 48 bits of each shingle, those first in the order first."""

    def per_batch():
        keys, places = heavy.value
        hashes = WordHashes()

        def one(s: np.ndarray) -> list:
            n = len(s)
            size = min(n, prefix_size(n, percent, shared_size(n)))
            rare, often = _ordered(s, keys, places, size)
            return (np.concatenate([rare[:size], often[: max(0, size - len(rare))]]) >> np.uint64(16)).astype(np.int64).tolist()

        def run(texts: list) -> dict[str, list]:
            sets = [shingles(t, hashes, width) for t in texts]
            return {"n": [len(s) for s in sets], "first": [one(s) if len(s) else [] for s in sets]}

        return run

    return per_batch


def _traits(heavy, percent: int, width: int):
    """Each set, its prefixes under the second and third order (31 bits of each shingle), and its parity sketch."""

    def per_batch():
        keys, places = heavy.value
        hashes = WordHashes()

        def one(s: np.ndarray) -> tuple[list, list, list, list]:
            p = prefix_size(len(s), percent)
            rare, often = _ordered(s, keys, places, p)
            out = []
            for k in (1, 2):
                own = np.concatenate([rare, often[: p - len(rare)]]) if len(rare) <= p else rare[np.argpartition(rare * MULTIPLIERS[k], p - 1)[:p]]
                out.append((own >> np.uint64(33)).astype(np.int32).tolist())
            odd = np.bincount((s >> np.uint64(11) & np.uint64(64 * SKETCH - 1)).astype(np.int64), minlength=64 * SKETCH) & 1
            return *out, np.packbits(odd.astype(np.uint8)).view(np.int64).tolist(), s.view(np.int64).tolist()

        def run(texts: list) -> dict[str, list]:
            sets = [shingles(t, hashes, width) for t in texts]
            found = [one(s) for s in sets]
            return {"n": [len(s) for s in sets]} | {name: [x[k] for x in found] for k, name in enumerate(("second", "third", "sketch", "s"))}

        return run

    return per_batch


def _may_link(a: str, b: str, percent: int) -> Column:
    """Whether sizes and sketches allow the similarity: sets that link differ in n + m - 2 ceil(t (n + m) / (1 + t)) members at most."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    both = n + m
    least = F.floor((percent * both + (99 + percent)) / F.lit(100 + percent))
    differ = sum((F.bit_count(F.col(f"{a}.k{i}").bitwiseXOR(F.col(f"{b}.k{i}"))) for i in range(SKETCH)), F.lit(0))
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (differ <= both - 2 * least)


def _members(prefixes: DataFrame, percent: int) -> DataFrame:
    """(token, uid, core) of the first order's prefix shingles that sets share, for the sets that share enough of them. core: whether the shorter prefix, for one shared shingle, has it.

    A set that links with one of m members shares shared_size(m) of them at least, and m is percent of its own size or more.
    """
    ceiling = F.floor((percent * F.col("n") + 99) / F.lit(100))
    # token and core in one number: rows are short, and so are the lists of them
    token = F.shiftright("packed", 1)
    packed = F.shiftleft("token", 1) + (F.col("pos") < F.col("n") - ceiling + 1).cast("long")
    member = prefixes.select("uid", "n", (1 + F.floor(ceiling / F.lit(10))).cast("int").alias("least"), F.posexplode("first").alias("pos", "token")).select("uid", "least", packed.alias("packed"))
    kept = None
    for parts in (TOKEN_PARTS, 1):  # sets that went leave others with too few
        met = []
        for k in range(parts):
            part = member.where(F.pmod(token, F.lit(parts)) == k)
            shared = part.groupBy(token.alias("token")).agg(F.count(F.lit(1)).alias("members")).where("members > 1").select("token")
            met.append(materialise(part.join(shared, token == F.col("token")).select("uid", "least", "packed")))
        held = reduce(DataFrame.unionByName, met).groupBy("uid").agg(F.first("least").alias("least"), F.collect_list("packed").alias("held"))  # a set's own prefix at most
        old, kept = kept, materialise(held.where(F.size("held") >= F.col("least")))
        member = kept.select("uid", "least", F.explode("held").alias("packed"))
        discard(*met, *([] if old is None else [old]))
    out = materialise(member.select(token.alias("token"), "uid", (F.col("packed").bitwiseAND(F.lit(1)) == 1).alias("core")))
    discard(kept)
    return out


def _mixed(member: DataFrame, label: DataFrame | None) -> DataFrame:
    """member with each set's component, the tokens that still hold several."""
    if label is None:
        return member.withColumn("component", F.col("uid"))
    placed = member.join(label.withColumnRenamed("v", "uid"), "uid", "left").withColumn("component", F.coalesce("component", "uid"))
    several = placed.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("token")
    return placed.join(several, "token")


def _stars(placed: DataFrame, n: int) -> DataFrame:
    """Pairs (a, b): each set with the one lead of its tokens, of another component, with which it shares most."""
    order = F.struct(F.xxhash64("uid", F.lit(n)).alias("h"), F.col("uid").alias("lead"), F.col("component").alias("of"))
    lead = placed.groupBy("token").agg(F.min(order).alias("x")).select("token", "x.lead", "x.of")
    shares = placed.join(lead, "token").where("component <> of").groupBy("lead", "uid").agg(F.count(F.lit(1)).alias("n"))
    best = F.max(F.struct("n", (-F.col("lead")).alias("m"))).alias("best")
    return shares.groupBy("uid").agg(best).select((-F.col("best.m")).alias("a"), F.col("uid").alias("b"))


def _meeting(a: DataFrame, b: DataFrame, keys: tuple[str, ...], percent: int, once: Column) -> DataFrame:
    """Pairs (a, b) of rows with the same keys for which `once` holds, and that sizes and sketches allow. Two sets that share several tokens meet at the least of them only: a token that both carry is preceded by no shared one that either does not carry."""
    a, b = a.alias("a"), b.alias("b")
    least = F.coalesce(F.array_min(F.array_intersect("a.tokens", "b.tokens")) == F.col("a.token"), F.lit(True))
    same = reduce(Column.__and__, (F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys))
    pairs = a.join(b, same & once & F.when(_may_link("a", "b", percent), least).otherwise(False))
    return pairs.select(F.col("a.uid").alias("a"), F.col("b.uid").alias("b")).distinct()


def _groups(placed: DataFrame, cards: DataFrame, percent: int, size: int) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of different components that meet in a chance group of about `size` members of a bucket (all of it, if it has no more), and a table that is to be discarded after them."""
    group = F.pmod(F.xxhash64("uid", F.lit(size)), F.ceil(F.col("members") / size))
    dealt = materialise(placed.select("token", "uid", "component", group.alias("group")).join(cards, "uid"))
    return _meeting(dealt, dealt, ("token", "group"), percent, F.col("a.component") < F.col("b.component")), dealt


def _blocks(placed: DataFrame, cards: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """All pairs (a, b) of different components that meet in a bucket, and a table that is to be discarded after them. A bucket's pairs are dealt out by pairs of blocks, each pair to one; of two sets one is outside the bucket's largest component."""
    largest = placed.groupBy("token", "component").agg(F.count(F.lit(1)).alias("n")).groupBy("token").agg(F.max(F.struct("n", "component")).alias("x")).select("token", F.col("x.component").alias("largest"))
    blocks = F.ceil(F.col("members") / BLOCK)
    own = placed.join(largest, "token").select("token", "uid", "component", (F.col("component") != F.col("largest")).alias("outside"), blocks.alias("blocks"), F.pmod(F.xxhash64("uid"), blocks).alias("block"))
    dealt = own.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select("token", "uid", "component", "outside", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
    dealt = materialise(dealt.join(cards, "uid"))
    once = (F.col("a.block") != F.col("b.block")) | (F.col("a.lo") == F.col("a.hi"))
    once &= (F.col("a.component") < F.col("b.component")) | ((F.col("a.component") != F.col("b.component")) & ~F.col("b.outside"))
    return _meeting(dealt.where("outside"), dealt, ("token", "lo", "hi"), percent, once), dealt


def _verified(pairs: DataFrame, traits: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) that link: sizes and sketches allow it, they share prefix shingles under the second and the third order, and enough of all."""
    traits = pick(traits, pairs.select(F.explode(F.array("a", "b")).alias("uid")).distinct(), "uid", "left_semi")
    x, y = (traits.select(F.col("uid").alias(c), F.struct("n", "second", "third", "s", *(F.col("sketch")[i].alias(f"k{i}") for i in range(SKETCH))).alias(v)) for c, v in (("a", "x"), ("b", "y")))
    both = pairs.join(x, "a").join(y, "b")
    filters = _may_link("x", "y", percent) & F.arrays_overlap("x.second", "y.second") & F.arrays_overlap("x.third", "y.third")
    common = F.size(F.array_intersect("x.s", "y.s"))
    enough = F.when(filters, 100 * common >= percent * (F.col("x.n") + F.col("y.n") - common)).otherwise(False)
    return materialise(both.where(enough).select("a", "b"))


def _heavy(first: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The frequent shingles, ascending, and their places by frequency. The count from which one is kept leaves HEAVY of them at most."""
    counts = first.select(F.explode(F.arrays_zip("heavy", "heavy_n")).alias("x")).groupBy("x.heavy").agg(F.sum("x.heavy_n").alias("n"))
    counts = materialise(counts)
    steps = counts.groupBy(F.floor(4 * F.log2("n")).alias("step")).count().orderBy(F.desc("step")).collect()
    kept, least = 0, None
    for r in steps:
        kept += r["count"]
        if kept > HEAVY:
            break
        least = r.step
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    found = counts.where(F.floor(4 * F.log2("n")) >= least).toArrow()
    keys = found["heavy"].to_numpy().view(np.uint64)
    order = np.lexsort((keys, found["n"].to_numpy()))
    places = np.empty(len(keys), np.int64)
    places[order] = np.arange(len(keys))
    by_key = np.argsort(keys)
    return keys[by_key], places[by_key]


def link(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, width: int = WORDS) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of docs, with its row number `uid`; sets of `width` words' shingles link at `percent`."""
    return _link(numbered(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), "uid"), percent, width)


def _link(rows: DataFrame, percent: int, width: int) -> DataFrame:
    """What link() returns, of numbered rows (doc_id, text, uid)."""
    spark = rows.sparkSession
    first = materialise(map_texts(rows, "text", ("doc_id", "uid"), _first_pass(width), "n long, digest binary, heavy array<bigint>, heavy_n array<bigint>"))
    every = first.select("doc_id", "uid", "n", "digest")
    heavy = spark.sparkContext.broadcast(_heavy(first))
    classes = materialise(every.where("n > 0").groupBy("digest").agg(F.min("uid").alias("uid"), F.min("doc_id").alias("least"), F.first("n").alias("n")))

    copies = materialise(every.where("n > 0").select("uid").join(classes.select("uid"), "uid", "left_anti"))
    alone = pick(rows, copies, "uid", "left_anti")
    prefixes = materialise(map_texts(alone, "text", ("uid",), _first_prefixes(heavy, percent, width), "n long, first array<bigint>").where("n > 0"))
    member = _members(prefixes, percent)
    discard(prefixes, copies)
    left = materialise(member.select("uid").distinct())
    traits = materialise(map_texts(pick(rows, left, "uid", "left_semi"), "text", ("uid",), _traits(heavy, percent, width), "n long, second array<int>, third array<int>, sketch array<bigint>, s array<bigint>"))
    heavy.destroy()
    discard(left)
    marks = traits.select("uid", "n", *(F.col("sketch")[i].alias(f"k{i}") for i in range(SKETCH)))

    links, label = [], None

    def linked(placed: DataFrame, pairs: DataFrame, *gone: DataFrame) -> DataFrame:
        """The components after the links among pairs."""
        pairs = materialise(pairs)
        discard(placed, *gone)
        found = _verified(pairs, traits, percent)
        discard(pairs)
        if label is not None and found.isEmpty():
            return label
        links.append(found)
        new = components(reduce(DataFrame.unionByName, links))
        if label is not None:
            discard(label)
        return new

    for n in range(STARS):
        placed = materialise(_mixed(member, label))
        label = linked(placed, _stars(placed, n))
    core = member.where("core").select("token", "uid")
    tokens = core.groupBy("uid").agg(F.collect_list("token").alias("tokens"))
    tokens = tokens.select("uid", F.when(F.size("tokens") <= CARRIED, F.col("tokens")).otherwise(F.slice(F.array_sort("tokens"), 1, FEW)).alias("tokens"))
    cards = materialise(marks.join(tokens, "uid"))
    open_ = materialise(core.join(core.groupBy("token").agg(F.count(F.lit(1)).alias("members")).where("members > 1"), "token"))
    size = 0
    while size < BLOCK and not open_.isEmpty():
        size = min(BLOCK, size * WIDER or FIRST_PART)
        placed = materialise(_mixed(open_, label))
        label = linked(placed, *_groups(placed, cards, percent, size))
        old, open_ = open_, materialise(open_.where(F.col("members") > size))
        discard(old)
    if not open_.isEmpty():
        placed = materialise(_mixed(open_, label))
        label = linked(placed, *_blocks(placed, cards, percent))
    discard(open_, cards)

    of = classes.join(label.withColumnRenamed("v", "uid"), "uid", "left").withColumn("component", F.coalesce("component", "uid"))
    least = of.groupBy("component").agg(F.min("least").alias("component_id"))
    named = materialise(of.join(least, "component").select("digest", "component_id"))
    discard(classes, member, traits, *links)
    return every.join(named, "digest", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "uid"
    )


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = NEAR_PERCENT, width: int = NEAR_WORDS) -> DataFrame:
    """docs with one row of each group left: that with the smallest id (null last), and the first row of these. Rows without words are groups of their own."""
    uid = free_name(docs, "row_uid")
    fixed = numbered(docs, uid)
    linked = _link(fixed.select(F.col(uid).alias("doc_id"), F.col(text_col).alias("text"), F.col(uid).alias("uid")), percent, width).select(F.col("doc_id").alias(uid), "component_id")
    ids = fixed.select(uid, F.col(id_col).alias("id_")).join(linked, uid)
    ranked = F.struct(F.col("id_").isNull().alias("none"), "id_", uid)
    first = ids.groupBy("component_id").agg(F.min(ranked).alias("x")).select(F.col(f"x.{uid}").alias(uid))
    gone = materialise(linked.select(uid).join(first, uid, "left_anti"))
    return pick(fixed, gone, uid, "left_anti").select(*docs.columns)


def op3_multi_order_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of every document at a 3-word shingle similarity of 90 %."""
    return link(table(spark, sf_dir, "documents")).drop("uid")


ORACLE = r"""
with recursive d as (select doc_id, row_number() over () as uid, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select uid, list_distinct(case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
  else list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) end) as g from d),
f as (select uid, len(g) as n, unnest(g) as x from s),
shared as (select a.uid as a, b.uid as b, a.n as n, b.n as m, count(*) as c from f a join f b on a.x = b.x and a.uid <> b.uid group by a.uid, b.uid, a.n, b.n),
e as (select a, b from shared where 100 * c >= 90 * (n + m - c)),
r(a, b) as (select uid, uid from d union select r.a, e.b from r join e on r.b = e.a),
l as (select r.a as uid, min(d.doc_id) as component_id from r join d on d.uid = r.b group by r.a)
select doc_id, len(g)::bigint as n_shingles, component_id from d join s using (uid) join l using (uid)
"""
