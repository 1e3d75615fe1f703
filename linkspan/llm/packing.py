"""Lexical retrieval packing: related documents share sequences.

Documents are tokenised once, each closed by ``END``, and dealt to index shards by min-hashes of
their runs of three tokens, so that near copies meet. A cell of the first min-hash that holds more
than ``SHARD_TOKENS`` is parted by the second, and so on; only what agrees in all ``MIN_HASHES`` and is
too large still is split by a hash of the row. The driver sees only counts of at most ``CELLS`` cells
a shard wanted. In each shard a BM25 inverted index over token ids is built. The
first unused document becomes the seed of a sequence; all its indexed terms are
looked up, and the best unused neighbours fill the window, greedily by score. The last one is cut
where the window ends, and its rest opens the next sequence as the seed. So all sequences but a
shard's last are full.

Tokens come from a cache of white-space separated chunks: the tokenizer never joins across white
space, so a text's ids are those of its chunks in turn, and a chunk's those of its pieces. A batch's
texts are parted and its chunks told apart by Arrow, only the different ones are looked up, and the
ids are put together by numpy. Texts with characters beyond the plain ones (see ``PLAIN``) or with the
tokenizer's own marks go through the tokenizer as a whole.

Scores are sums of whole numbers (a term's weight times ``UNIT``, rounded), so they do not depend on
the order of summing. Terms that a quarter of a shard's documents hold have dense rows, which are
added as they are; the others' postings are gathered and summed by document.

Defined cases: a null or empty text is the one id ``END``; null ids and repeated rows are rows like
any other, a row's pieces never mix with another's; texts longer than a sequence are cut into as
many as they need; further columns are ignored; an empty table gives an empty result. Ties in score
go to the smaller row number.
"""

from __future__ import annotations

import json
import os
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer, normalizers, pre_tokenizers

from linkspan.llm.common import BROADCAST_ROWS, map_texts, materialise, table

SEQUENCE = 4096
END = 2
#: Tokens of an index shard, and cells of the min-hash that shards are put together from.
SHARD_TOKENS = 4_000_000
CELLS = 64
MAX_SHARDS = 65_536
MIN_HASHES = 4
MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64)
K1, B = 1.2, 0.75
#: Scores are whole numbers of this part of one.
UNIT = 4096
#: A term that a document in DENSE holds has a dense row; rows take 4 bytes a document, so all take 4 x DENSE bytes a posting at most.
DENSE = 4
#: Chunks and pieces that a Python worker keeps, from task to task (about 200 bytes each); the half that is used most outlives a clearing.
CACHED = 800_000
#: Texts whose chunks are looked up together.
TEXTS = 1000
#: Characters of which it is sure where the tokenizer parts them: ASCII, accented Latin letters and general punctuation.
PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa1-\xac\xae-\xb1\xb4-\xb8\xba\xbb\xbf-\u012f\u0131-\u024f\u2010-\u2027\u20ac]*")
#: Fixed value: the pattern of tokenizers that the cache serves.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The tokenizer's own pieces of a lower-cased chunk of such characters; words, and words before one mark, are told without a search.
PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|[0-9]|(?:[^\w\s]|_)+")


class Chunks:
    """Chunks of text, and pieces of chunks, to their ids: each has a place in one array of ids.

    An unknown chunk is put together from its pieces, and unknown pieces are encoded many at a
    time: a piece's last id, and no other, is of a token that ends a word.
    """

    def __init__(self, tokenizer, kind: np.dtype):
        self.tokenizer, self.kind = tokenizer, kind
        told = json.loads(tokenizer.to_str())
        parts = [x["pattern"].get("Regex") for x in (told["pre_tokenizer"] or {}).get("pretokenizers", []) if x["type"] == "Split"]
        #: Whether the tokenizer parts texts as PIECES does; any other is given whole texts.
        self.applies = parts == [SPLIT] and told["model"].get("end_of_word_suffix") == "</w>"
        self.slim = Tokenizer.from_str(json.dumps(told))  # for pieces, which need no normalising and no search
        self.slim.normalizer = normalizers.Sequence([])
        self.slim.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.closes = np.zeros(tokenizer.get_vocab_size(), bool)
        for token, i in tokenizer.get_vocab().items():
            self.closes[i] = token.endswith("</w>")
        self.known: dict[str, int] = {"": 0}
        #: By number: where a chunk's ids start, how many they are, and how often batches had it. The empty chunk is the first.
        self.start, self.size, self.uses = (np.zeros(1, t) for t in (np.int64, np.int32, np.int32))
        self.ids = np.zeros(0, kind)

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind)

    def _add(self, names: list[str], sizes: np.ndarray, ids: np.ndarray) -> None:
        first = len(self.size)
        self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(sizes) - sizes])
        self.size = np.concatenate([self.size, sizes.astype(np.int32)])
        self.uses = np.concatenate([self.uses, np.zeros(len(sizes), np.int32)])
        self.ids = np.concatenate([self.ids, ids])
        self.known.update(zip(names, range(first, first + len(names)), strict=True))

    def _clear(self) -> None:
        """Forget the chunks that fewer batches had, and count the others' uses half."""
        keep = self.uses > np.partition(self.uses, len(self.uses) // 2)[len(self.uses) // 2]
        keep[0] = True
        new = np.cumsum(keep) - 1
        self.known = {c: int(new[k]) for c, k in self.known.items() if keep[k]}
        self.ids = self.gather(np.flatnonzero(keep))[0]
        self.size, self.uses = self.size[keep], self.uses[keep] >> 1
        self.start = np.cumsum(self.size, dtype=np.int64) - self.size

    def gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of chunks in a row, and how many each has."""
        sizes = self.size[numbers].astype(np.int64)
        shift = self.start[numbers] - (np.cumsum(sizes) - sizes)
        return self.ids[np.repeat(shift, sizes) + np.arange(int(sizes.sum()))], sizes

    def _encode_pieces(self, new: list[str]) -> None:
        for i in range(0, len(new), 5000):
            some = new[i : i + 5000]
            lines = [" ".join(some[k : k + 100]) for k in range(0, len(some), 100)]
            ids = np.concatenate([np.array(e.ids, self.kind) for e in self.slim.encode_batch_fast(lines, add_special_tokens=False)])
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) == len(some):
                self._add(some, np.diff(ends, prepend=0), ids)
            else:  # never seen; each by itself is right in any case
                each = [self.encode(x) for x in some]
                self._add(some, np.array([len(x) for x in each], np.int64), np.concatenate(each))

    def numbers(self, chunks: list[str]) -> np.ndarray:
        """The numbers of different chunks; those that are not known are encoded first."""
        if len(self.size) > CACHED:
            self._clear()
        known = self.known
        found = list(map(known.get, chunks))
        gaps = [i for i, k in enumerate(found) if k is None]
        if gaps:
            new = [chunks[i] for i in gaps]
            # flat lists: many small ones would be searched for cycles again and again
            whole, split, parts, counts = [], [], [], []
            for c, low in zip(new, "\n".join(new).lower().split("\n"), strict=True):  # all lowered at once: a chunk has no line feed
                if low.isalpha():
                    if low == c:
                        whole.append(c)  # a piece itself
                        continue
                    parts.append(low)
                    counts.append(1)
                elif low[-1] in ".,;:!?" and (head := low[:-1]).isalpha():
                    parts.append(head)
                    parts.append(low[-1])
                    counts.append(2)
                else:
                    p = PIECES.findall(low)
                    parts += p
                    counts.append(len(p))
                split.append(c)
            self._encode_pieces(list({*whole, *parts}.difference(known)))
            if split:
                ids, sizes = self.gather(np.fromiter(map(known.__getitem__, parts), np.int64, len(parts)))
                own = np.array(counts)
                self._add(split, np.add.reduceat(sizes, np.cumsum(own) - own), ids)
            for i, c in zip(gaps, new, strict=True):
                found[i] = known[c]
        out = np.array(found, np.int64)
        self.uses[out] += 1
        return out


_kept: dict[str, Chunks] = {}


def chunks_of(path: str, end: int) -> Chunks:
    """This worker's cache for a tokenizer file."""
    if path not in _kept:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tokenizer = Tokenizer.from_file(path)
        _kept.clear()
        _kept[path] = Chunks(tokenizer, np.dtype("<u2" if max(tokenizer.get_vocab_size(), end + 1) <= 1 << 16 else "<u4"))
    return _kept[path]


def min_hashes(ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each document, given by where it ends, the least hash of its runs of three ids (fewer, if it has no more) in each of several orders."""
    starts = np.concatenate([[0], ends[:-1]])
    x = ids.astype(np.uint64) + np.uint64(1)
    h = x * MULTIPLIERS[0]
    for k in (1, 2):
        after = np.zeros_like(x)
        after[: len(x) - k] = x[k:]
        for j in range(1, k + 1):
            at = ends - j
            after[at[at >= starts]] = 0  # the document has no more
        h += after * MULTIPLIERS[k]
    h ^= h >> np.uint64(29)
    short = np.concatenate([at[at > np.maximum(starts, ends - 3) if j < 3 else at > starts] for j, at in ((1, ends - 1), (2, ends - 2))])
    out = []
    for m in MULTIPLIERS[:MIN_HASHES]:
        h = h * m
        h ^= h >> np.uint64(32)
        order = h >> np.uint64(1)
        order[short] = np.uint64(2**63 - 1)  # runs that stop short of three count in documents of fewer only
        out.append(np.minimum.reduceat(order, starts).astype(np.int64))
    return np.stack(out, axis=1)


def ids_of(texts: list, chunks: Chunks, marks: list[str], end: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts in a row, each closed by `end`, and where each ends."""
    plain = [bool(chunks.applies and (not t or PLAIN.fullmatch(t) and not any(m in t for m in marks))) for t in texts]
    words = pc.ascii_split_whitespace(pa.array([t if ok and t else "" for t, ok in zip(texts, plain, strict=True)], pa.large_string()))
    told = words.flatten().dictionary_encode()
    numbers = chunks.numbers(told.dictionary.to_numpy(zero_copy_only=False).tolist())
    ids, sizes = chunks.gather(numbers[told.indices.to_numpy()])
    totals = np.concatenate([[0], np.cumsum(sizes)])
    counts = np.diff(totals[words.offsets.to_numpy()])
    if all(plain):
        ends = np.cumsum(counts)
        return np.insert(ids, ends, end), np.cumsum(counts + 1)
    at, out = np.concatenate([[0], np.cumsum(counts)]), []
    for i, (t, ok) in enumerate(zip(texts, plain, strict=True)):
        out += [ids[at[i] : at[i + 1]] if ok else chunks.encode(t) if t else ids[:0], np.array([end], chunks.kind)]
    return np.concatenate(out), np.cumsum([len(x) + 1 for x in out[::2]])


def _ids(path: str, end: int):
    """A function from texts to their ids and what is known of them."""

    def per_batch():
        chunks = chunks_of(path, end)
        marks = [t.content for t in chunks.tokenizer.get_added_tokens_decoder().values()]

        def some(texts: list) -> tuple[list, list, list]:
            ids, ends = ids_of(texts, chunks, marks, end)
            raw, at = ids.tobytes(), (np.concatenate([[0], ends]) * ids.itemsize).tolist()
            return [raw[a:b] for a, b in zip(at, at[1:], strict=False)], np.diff(ends, prepend=0).tolist(), min_hashes(ids, ends).tolist()

        def run(texts: list) -> dict[str, list]:
            found = [some(texts[i : i + TEXTS]) for i in range(0, len(texts), TEXTS)]
            return {name: [x for f in found for x in f[k]] for k, name in enumerate(("ids", "doc_tokens", "least"))}

        return run

    return per_batch


class Index:
    """A BM25 inverted index over the ids of a shard's documents. Terms of one document only find nothing."""

    def __init__(self, documents: list[np.ndarray]):
        pairs = [np.unique(x, return_counts=True) for x in documents]
        sizes = np.array([len(t) for t, _ in pairs])
        n = len(documents)
        doc = np.repeat(np.arange(n, dtype=np.int32), sizes)
        raw = np.concatenate([t for t, _ in pairs])
        tf = np.concatenate([c for _, c in pairs]).astype(np.float64)
        lengths = np.array([len(x) for x in documents], dtype=np.float64)
        df = np.bincount(raw)
        idf = np.where(df > 1, np.log1p((n - df + 0.5) / (df + 0.5)), 0.0)
        weight = tf * (K1 + 1) / (tf + K1 * (1 - B + B * (lengths / lengths.mean())[doc])) * idf[raw]
        weight = np.rint(weight * UNIT).astype(np.int32)
        order = np.argsort(raw, kind="stable")  # short numbers are sorted by radix
        self.n, self.df, self.starts = n, df, np.concatenate([[0], np.cumsum(df)])
        self.posting, self.weight = doc[order].astype(np.int64), weight[order]
        self.rows = np.full(len(df), -1, np.int64)
        often = np.flatnonzero((df * DENSE >= n) & (df > 1))
        self.rows[often] = np.arange(len(often))
        self.dense = np.zeros((len(often), n), np.int32)
        for k, t in enumerate(often.tolist()):
            own = slice(self.starts[t], self.starts[t + 1])
            self.dense[k, self.posting[own]] = self.weight[own]
        self.terms, self.at = raw.astype(np.int64), np.concatenate([[0], np.cumsum(sizes)])

    def scores(self, seed: int) -> np.ndarray:
        """Every document's score for all the seed's terms."""
        terms = self.terms[self.at[seed] : self.at[seed + 1]]
        terms = terms[self.df[terms] > 1]
        rows = self.rows[terms]
        rare = terms[rows < 0]
        sizes = self.df[rare]
        place = np.repeat(self.starts[rare] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
        out = np.bincount(self.posting[place], weights=self.weight[place], minlength=self.n).astype(np.int64)
        total = np.zeros(self.n, np.int32)  # a sum of fewer than 2**16 weights below 2**15 each
        for k in rows[rows >= 0].tolist():
            total += self.dense[k]
        return out + total


def ranked(score: np.ndarray, used: np.ndarray, most: int | None = None) -> np.ndarray:
    """The unused documents with a score, best first; `most` of them at least, and all of the same score."""
    score = np.where(used, 0, score)
    if most is not None and len(score) > most:
        least = np.partition(score, len(score) - most)[len(score) - most]
        open_ = np.flatnonzero(score >= least if least > 0 else score > 0)
    else:
        open_ = np.flatnonzero(score > 0)
    return open_[np.lexsort((open_, -score[open_]))]


def plan(documents: list[np.ndarray], sequence: int = SEQUENCE) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of every piece."""
    index = Index(documents)
    used = np.zeros(len(documents), bool)
    pieces: list[tuple[int, int, int, int, int]] = []
    at, fill, seq, start = 0, 0, 0, 0
    queue: list[int] = []
    seed = -1
    while True:
        if not queue:
            if fill == 0 or seed < 0:  # a sequence opens, or the neighbours are used up: the next unused document
                while at < len(used) and used[at]:
                    at += 1
                if at == len(used):
                    return pieces
                seed = at
                used[at] = True
                queue = [seed]
            else:
                score = index.scores(seed)
                for most in (16, 256, None):  # few fill a window; where they do not, more are ranked
                    room, best = sequence - fill, []
                    for d in ranked(score, used, most).tolist():
                        best.append(d)
                        room -= len(documents[d])
                        if room <= 0:
                            break
                    if room <= 0 or most is None or len(best) < most:
                        break
                used[best] = True
                queue, seed = best, -1
                continue
        d = queue.pop(0)
        while start < len(documents[d]):
            length = min(sequence - fill, len(documents[d]) - start)
            pieces.append((d, start, length, seq, fill))
            start, fill = start + length, fill + length
            if fill == sequence:
                seq, fill, seed = seq + 1, 0, d
        start = 0


def _pack(kind: str, sequence: int):
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("uid")
        ids = [np.frombuffer(x, kind) for x in rows["ids"].to_pylist()]
        pieces = plan(ids, sequence)
        doc, start, length, seq, offset = (np.array(x, np.int64) for x in zip(*pieces, strict=True))
        shard = rows["shard"][0].as_py()
        crc = [zlib.crc32(ids[d][s : s + n].astype("<u4").tobytes()) for d, s, n, _, _ in pieces]
        picked = rows.select(["doc_id", "uid", "doc_tokens"]).take(pa.array(doc))
        columns = {"start": start, "length": length, "ids_crc32": np.array(crc, np.int64), "sequence_id": (np.int64(shard) << np.int64(32)) + seq, "offset": offset}
        for name, values in columns.items():
            picked = picked.append_column(name, pa.array(values, pa.int64()))
        return picked

    return run


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", sequence: int = SEQUENCE, end: int = END) -> DataFrame:
    """The pieces of all rows of docs: doc_id, uid (the row's number), doc_tokens, start, length, ids_crc32, sequence_id and offset."""
    kind = "<u2" if max(Tokenizer.from_file(tokenizer).get_vocab_size(), end + 1) <= 1 << 16 else "<u4"
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("uid"))
    done = materialise(map_texts(rows, "text", ("doc_id", "uid"), _ids(tokenizer, end), "ids binary, doc_tokens long, least array<bigint>"))
    tokens = done.agg(F.sum("doc_tokens")).first()[0] or 0
    shards = int(min(MAX_SHARDS, max(1, -(-tokens // SHARD_TOKENS))))
    cells = shards * CELLS
    placed = done.withColumn("cell", F.pmod(F.xxhash64(F.col("least")[0]), F.lit(cells)))
    counts = placed.groupBy("cell").agg(F.sum("doc_tokens").alias("n")).orderBy("cell").collect()
    # a cell beyond a shard's size makes room for cells of its own among the others, by the next min-hash
    for k in range(1, MIN_HASHES):
        if all(r.n <= SHARD_TOKENS for r in counts):
            break
        first, moved = 0, []
        for r in counts:
            own = CELLS * -(-r.n // SHARD_TOKENS) if r.n > SHARD_TOKENS else 1
            moved.append((r.cell, first, own))
            first += own
        to = spark.createDataFrame(moved, "cell long, first long, own long")
        placed = placed.join(F.broadcast(to) if len(moved) <= BROADCAST_ROWS else to, "cell").withColumn("cell", F.col("first") + F.pmod(F.xxhash64(F.col("least")[k]), F.col("own"))).drop("first", "own")
        counts = placed.groupBy("cell").agg(F.sum("doc_tokens").alias("n")).orderBy("cell").collect()
    # cells fill shards in turn; one still beyond a shard's size has shards of its own, dealt by a hash of the row
    own, opened, room = [], 0, 0
    for r in counts:
        parts = -(-r.n // SHARD_TOKENS)
        if parts > 1:
            own.append((r.cell, opened, parts))
            opened, room = opened + parts, 0
        else:
            if r.n > room:
                opened, room = opened + 1, SHARD_TOKENS
            own.append((r.cell, opened - 1, 1))
            room -= r.n
    where = spark.createDataFrame(own, "cell long, first long, parts long")
    dealt = placed.join(F.broadcast(where) if len(own) <= BROADCAST_ROWS else where, "cell")
    dealt = dealt.select("doc_id", "uid", "doc_tokens", "ids", (F.col("first") + F.pmod(F.xxhash64("uid"), F.col("parts"))).alias("shard"))
    schema = "doc_id long, uid long, doc_tokens long, start long, length long, ids_crc32 long, sequence_id long, offset long"
    # one partition a shard on average: what a task holds does not grow with the input
    return dealt.repartition(max(1, opened), "shard").groupBy("shard").applyInArrow(_pack(kind, sequence), schema)


def op10_bm25_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4,096 tokens."""
    import public_tokenizers

    pieces = pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
