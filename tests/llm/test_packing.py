"""Sharding and packing: exact round trips."""

import math
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from edge import clashing, documents, edge_rows
from tokenizers import Tokenizer

from linkspan.llm import packing, sharding

PATH = public_tokenizers.path("word_bpe_49k.json")


def truth(texts):
    t = Tokenizer.from_file(PATH)
    return [t.encode(x or "", add_special_tokens=False).ids + [2] for x in texts]


ODD = ["Don't STOP's 3rd ½ naïve co-operate", "<|endoftext|> in <|startoftext|>", "é  x y ﬁ Σας", "日本語 テスト", "a\x1cb\x85c", "x" * 5000, "İstanbul ÀÉ", "tab\tnew\nline\x0bv", "'s't're've'm'll'd 12345"]


def check(rows, pieces, sequence):
    want = defaultdict(list)
    for (i, _), ids in zip(rows, truth([t for _, t in rows]), strict=True):
        want[i].append(ids)
    by_row, by_seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_row[p.uid].append(p)
        by_seq[p.sequence_id].append(p)
    assert len(by_row) == len(rows)
    for ps in by_row.values():
        ps.sort(key=lambda p: p.start)
        assert [p.start for p in ps] == list(np.cumsum([0] + [p.length for p in ps[:-1]])) and sum(p.length for p in ps) == ps[0].doc_tokens
        crcs = [p.ids_crc32 for p in ps]
        assert any([zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes()) for p in ps] == crcs for ids in want[ps[0].doc_id] if len(ids) == ps[0].doc_tokens)
    full = 0
    for ps in by_seq.values():
        ps.sort(key=lambda p: p.offset)
        assert [p.offset for p in ps] == list(np.cumsum([0] + [p.length for p in ps[:-1]]))
        n = sum(p.length for p in ps)
        assert 0 < n <= sequence
        full += n == sequence
    return full, len(by_seq)


def test_round_trip(spark):
    rows = [r[:2] for r in edge_rows()] + [(100 + i, t) for i, t in enumerate(ODD)] + [(200, "word soup " * 6000)]
    pieces = packing.pack(clashing(documents(spark, rows)), PATH, sequence=64).collect()
    full, n = check(rows, pieces, 64)
    assert full >= n - 1


def test_several_shards_and_a_hot_cell(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_TOKENS", 2000)
    rows = [(i, "the same copy of a text " * 8) for i in range(150)] + [(500 + i, f"text number {i} about thing {i % 7} " * (i % 9)) for i in range(100)]
    df = documents(spark, rows)
    one = packing.pack(df, PATH, sequence=128).collect()
    check(rows, one, 128)
    assert len({p.sequence_id >> 32 for p in one}) > 5


def test_neighbours_by_bm25():
    docs = [np.array(x) for x in ([1, 2, 3], [7, 8, 9], [1, 2, 4], [7, 8, 5], [6, 6, 6])]
    index = packing.Index(docs)
    for seed, near in ((0, [2]), (1, [3]), (4, [])):
        assert packing.ranked(index.scores(seed), np.arange(5) == seed).tolist() == near
    df = {t: sum(t in d for d in docs) for d in docs for t in d}
    score = sum(np.log1p((5 - df[t] + 0.5) / (df[t] + 0.5)) * (2.2 / (1 + 1.2 * (1 - 0.75 + 0.75 * 3 / 3))) for t in (1, 2))
    assert abs(index.scores(0)[2] - score * packing.UNIT) <= 2
    pieces = packing.plan(docs, 6)
    assert [p[0] for p in pieces] == [0, 2, 1, 3, 4]


def plain_plan(docs, sequence):
    """The same filling from the definition: each term of the seed, each document, one after the other."""
    n, mean = len(docs), sum(map(len, docs)) / len(docs)
    df = {}
    for d in docs:
        for t in set(d):
            df[t] = df.get(t, 0) + 1

    def score(seed, d):
        out = 0
        for t in set(seed):
            tf = d.count(t)
            if df[t] > 1 and tf:
                idf = math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5))
                out += round(tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * (len(d) / mean))) * idf * packing.UNIT)
        return out

    free, pieces, seq, fill, seed = list(range(n)), [], 0, 0, None
    while free or seed is not None:
        if seed is None:
            todo = [free.pop(0)]
        else:
            near = sorted((-score(docs[seed], docs[d]), d) for d in free)
            todo = [d for s, d in near if s < 0]
            if not todo:
                if not free:
                    break
                todo = [free.pop(0)]
                seed = None
        opened, seed = seed is None, todo[0] if seed is None else None
        for d in todo:
            if d in free:
                free.remove(d)
            at = 0
            while at < len(docs[d]):
                k = min(sequence - fill, len(docs[d]) - at)
                pieces.append((d, at, k, seq, fill))
                at, fill = at + k, fill + k
                if fill == sequence:
                    seq, fill, seed = seq + 1, 0, d
            if seed == d:
                if fill == 0:
                    seed = None
                break
        else:
            if not opened:
                seed = None
        if fill == 0:
            seed = None
    return pieces


@pytest.mark.parametrize("seed", range(6))
def test_plan_by_brute_force(seed):
    rng = random.Random(seed)
    docs = [[rng.randrange(3, 60) if rng.random() < 0.7 else rng.randrange(3, 9) for _ in range(rng.choice((1, 4, 9, 30, 90)))] + [2] for _ in range(60)]
    assert packing.plan([np.array(d, "<u2") for d in docs], 32) == plain_plan(docs, 32)


def test_cache_gives_the_tokenizers_ids(monkeypatch):
    monkeypatch.setattr(packing, "CACHED", 300)
    rng = random.Random(3)
    words = ["Don't", "it's", "'summer", "''s", "x'll've", "a.b", "1,234", "naïve", "Ünder", "ABC", "co-op", "(he", "said)", "—", "€5", "_x_", "…", "'", "o'", "we're."]
    texts = ["".join(rng.choice([*words, *(rng.choice("abcdefgh") * rng.randrange(1, 9) for _ in range(9))]) + rng.choice([" ", "  ", "\n", "\t", ""]) for _ in range(rng.randrange(60))) for _ in range(300)]
    run = packing._ids(PATH, 2)()
    got = [x for i in range(0, 300, 50) for x in run([*texts[i : i + 50], None, *ODD])["ids"]]
    want = [x for i in range(0, 300, 50) for x in truth([*texts[i : i + 50], None, *ODD])]
    assert [np.frombuffer(x, "<u2").tolist() for x in got] == want


def test_known_chunks_are_looked_up_once():
    """A new chunk among known ones does not make those be looked up again."""
    looked = []

    class Counted(dict):
        def get(self, key):
            looked.append(key)
            return super().get(key)

        def __getitem__(self, key):
            looked.append(key)
            return super().__getitem__(key)

    chunks = packing.Chunks(Tokenizer.from_file(PATH), np.dtype("<u2"))
    words = [f"Word{chr(97 + i % 26)}{chr(97 + i // 26)}." for i in range(300)]
    chunks.numbers(words)
    chunks.known = Counted(chunks.known)
    got = chunks.gather(chunks.numbers([*words, "quite-NEW"]))[0].tolist()
    assert got == truth([" ".join([*words, "quite-NEW"])])[0][:-1]
    assert looked.count(words[0]) == 1 and len(looked) < 2 * len(words)


def test_empty(spark):
    assert packing.pack(documents(spark, []), PATH).count() == 0 and sharding.shard(documents(spark, [])).count() == 0


def shards(df, **k):
    return sharding.shard(df, **k).collect()


def test_sharding_edges(spark):
    rows = edge_rows()
    got = shards(clashing(documents(spark, rows)), shards=3)
    assert sorted((repr(r.doc_id), r.size, r.text_crc32) for r in got) == sorted((repr(i), len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) and 0 <= k < 3 for k, s in slots.items())


@pytest.mark.parametrize("copies", [0, 400])
def test_shards_are_even(spark, monkeypatch, copies):
    monkeypatch.setattr(sharding, "GROUPS_PER_BUCKET", 200)
    rng = np.random.default_rng(2)
    rows = [(i, "w " * int(n)) for i, n in enumerate(rng.lognormal(4, 1, 1200))] + [(5000 + i, "the very same text " * 20) for i in range(copies)]
    got = shards(documents(spark, rows), shards=8)
    sizes, counts = defaultdict(int), defaultdict(int)
    for r in got:
        sizes[r.shard] += r.size
        counts[r.shard] += 1
    assert max(sizes.values()) < 1.05 * min(sizes.values()) and max(counts.values()) < 1.2 * min(counts.values())


def test_levels_between_buckets_and_driver(spark, monkeypatch):
    for name, value in (("GROUPS_PER_BUCKET", 20), ("FAN", 3), ("DRIVER_BINS", 60)):
        monkeypatch.setattr(sharding, name, value)
    rows = [(i, f"word{i} " * (i % 50)) for i in range(2000)]
    got = shards(documents(spark, rows), shards=6)
    slots, sizes = defaultdict(list), defaultdict(int)
    for r in got:
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r.size
    assert sorted(r.doc_id for r in got) == list(range(2000)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(sizes.values()) < 1.05 * min(sizes.values())


@pytest.mark.parametrize("same_id", [None, 7])
def test_repeated_rows_with_equal_ids_are_spread(spark, same_id):
    rows = [(same_id, "the very same row")] * 4000 + [(i, "another text " * (1 + i % 9)) for i in range(1000)]
    sizes = defaultdict(int)
    for r in shards(documents(spark, rows)):
        sizes[r.shard] += r.size
    assert len(sizes) == 40 and max(sizes.values()) < 1.05 * min(sizes.values())


def test_tokens_are_words(spark):
    got = {r.doc_id: r.tokens for r in shards(documents(spark, [(1, "  a \t\n b  "), (2, ""), (3, None), (4, "x"), (5, " \n ")]), shards=2)}
    assert got == {1: 2, 2: 0, 3: 0, 4: 1, 5: 0}


def test_place_by_brute_force():
    rng = np.random.default_rng(4)
    v = rng.lognormal(2, 1, (80, 3)).round(2)
    total, left, want = v.sum(axis=0), [[1.0] * 3 for _ in range(5)], [0] * 80
    unit = [[x / t * 5 for x, t in zip(row, total, strict=True)] for row in v.tolist()]
    for i in sorted(range(80), key=lambda i: (-max(unit[i]), i)):
        fits = [s for s in range(5) if left[s][0] >= unit[i][0]]
        best = max(fits, key=lambda s: (sum(a * b for a, b in zip(left[s], unit[i], strict=True)), -s)) if fits else max(range(5), key=lambda s: (left[s][0], -s))
        want[i], left[best] = best, [a - b for a, b in zip(left[best], unit[i], strict=True)]
    assert sharding.place(v, 5).tolist() == want


def test_small_groups_stay_together(spark):
    rows = [(i, f"text {i % 100} " * 30) for i in range(300)]
    at = defaultdict(set)
    for r in shards(documents(spark, rows), shards=4):
        at[r.text_crc32].add(r.shard)
    assert all(len(s) == 1 for s in at.values())
