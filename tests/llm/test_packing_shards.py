"""Copies and near copies meet in one index shard, however many shards there are."""

import random

import public_tokenizers
from edge import documents

from linkspan.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def shards_of(spark, rows):
    pieces = packing.pack(documents(spark, rows), PATH, sequence=128).collect()
    return {p.doc_id: p.sequence_id >> 32 for p in pieces}


def test_copies_meet(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_TOKENS", 2000)
    rng = random.Random(5)
    words = [f"{a}{b}" for a in ("red", "sun", "tree", "house", "water") for b in ("", "s", "ing", "er", "ly", "less")]
    texts = [["the", "common", "opening", "line"] + rng.choices(words, k=80) for _ in range(150)]
    near = [[*t[:-1], "end"] for t in texts]
    rows = [(i, " ".join(t)) for k, group in enumerate((texts, texts, near)) for i, t in enumerate(group, 1000 * k)]
    at = shards_of(spark, rows)
    assert len(set(at.values())) > 10
    assert all(at[i] == at[1000 + i] for i in range(150))
    assert sum(at[i] == at[2000 + i] for i in range(150)) > 120


def least(docs):
    return packing.min_hashes(packing.np.concatenate([packing.np.array(d, "<u2") for d in docs]), packing.np.cumsum([len(d) for d in docs]))


def test_min_hashes_tell_texts_apart():
    rng = random.Random(6)
    docs = [[rng.randrange(40) for _ in range(200)] + [2] for _ in range(200)]
    assert len({x[0] for x in least(docs).tolist()}) > 100 and least([[2], [5, 2], [7, 5, 2]]).shape == (3, 4)
    short = [[2], [5, 2], [0, 2], [2], [7, 5, 2], [1] * 9 + [2]]
    together = least(short + docs).tolist()
    assert together == [least([d]).tolist()[0] for d in short + docs]
    assert together[0] == together[3] and len({tuple(x) for x in together[:6]}) == 5


def test_all_terms_of_a_seed_are_asked_for():
    rare, often = list(range(100, 140)), list(range(10, 30))
    docs = [packing.np.array(x) for x in (rare + often, [*rare, 1], often, *[[k] for k in often], *[[900 + k] for k in range(60)])]
    found = packing.ranked(packing.Index(docs).scores(0), packing.np.arange(len(docs)) == 0).tolist()
    assert found[0] == 1 and 2 in found and len(found) == 2 + len(often)
