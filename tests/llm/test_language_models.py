"""Cross-entropy difference with the counts of unknown bigrams handed back; language identification gram by gram."""

import math
import zlib
from collections import Counter

import pytest
from edge import clashing, documents, edge_rows
from pyspark.sql import functions as F

from linkspan.llm import language_id, lm_scoring
from linkspan.llm.common import table

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def model(texts, vocabulary, inventory):
    """p(word) and p(word | word before), None being the unknown word."""
    one = Counter(w if w in vocabulary else None for t in texts for w in t)
    two = Counter(b for t in texts for b in zip(t, t[1:], strict=False) if b in inventory)
    taken = Counter()
    for (v, _), n in two.items():
        taken[v if v in vocabulary else None] += n
    total = sum(one.values())

    def p(w, v=None, first=True):
        x = (one[w if w in vocabulary else None] + 1) / (total + len(vocabulary) + 1)
        if first:
            return x
        c = one[v if v in vocabulary else None]
        return (two[v, w] + (5 + c - taken[v if v in vocabulary else None]) * x) / (c + 5)

    return p


@pytest.mark.parametrize("limit", [4_000_000, 0])
def test_losses_with_counts_handed_back(spark, limit):
    rows = [(r.doc_id, r.text) for r in table(spark, SMALL, "documents").select("doc_id", "text").limit(60).collect()] + [(x[0], x[1]) for x in edge_rows()]
    good = {r[0] for r in rows[::3] if r[0] is not None}
    texts = [(t or "").encode().lower().split() for _, t in rows]
    target = [t for (i, _), t in zip(rows, texts, strict=True) if i in good]
    vocabulary = {w for w, n in Counter(w for t in target for w in t).items() if n >= 2}
    inventory = {b for b, n in Counter(b for t in target for b in zip(t, t[1:], strict=False)).items() if n >= 3}
    models = [model(ts, vocabulary, inventory) for ts in (target, texts)]
    some = sorted(vocabulary)[:3] + [b"no such word"]
    assert inventory and all(math.isclose(sum(p(w, v, False) for w in [*vocabulary, None]), 1) for p in models for v in some)
    want = [(len(t), *(-sum(math.log(p(w, t[k - 1], k == 0)) for k, w in enumerate(t)) / len(t) for p in models)) if t else (0, None, None) for t in texts]
    ids = spark.createDataFrame([(i,) for i in good], "id long")
    out = lm_scoring.score(clashing(documents(spark, rows)), ids, broadcast_grams=limit, hand_back=True).collect()
    key = lambda x: tuple(-1 if v is None else round(v, 6) for v in x)
    assert sorted(key((r.n_tokens, r.target_loss, r.background_loss)) for r in out) == sorted(map(key, want))


def test_rare_words_and_bigrams_alone_are_shuffled(spark, monkeypatch):
    """Beyond the limit, the frequent ones are scored where texts are read, and the losses are the same; no row of a text's unknown bigrams is made but for what the bitmap lets through."""
    docs, labels = table(spark, SMALL, "documents"), table(spark, SMALL, "labels").where("quality = 1").select("doc_id")
    written = []
    monkeypatch.setattr(lm_scoring, "materialise", lambda df, f=lm_scoring.materialise: written.append(f(df)) or written[-1])
    key = lambda x: tuple(-1 if v is None else round(v, 9) for v in x)
    for hand_back in (True, False):
        want, got = (sorted(key(r) for r in lm_scoring.score(docs, labels, broadcast_grams=n, hand_back=hand_back).collect()) for n in (4_000_000, 1000))
        assert want == got
    sent = [r for df in written if "keys" in df.columns for r in df.collect()]
    words = sum(r.n_tokens for r in sent)
    assert len(sent) == 2 * docs.count() and 0 < sum(len(r.keys) for r in sent) < words  # all words and bigrams are twice as many


def test_op7_ranks_good_documents_first(spark):
    labels = table(spark, MIDDLE, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    means = {r.quality: r.m for r in lm_scoring.op7_cross_entropy_difference(spark, MIDDLE).join(labels, "doc_id").groupBy("quality").agg(F.avg("score").alias("m")).collect()}
    assert means[1] < means[0]


def test_held_out_good_documents_come_first(spark):
    labels = table(spark, MIDDLE, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    shown = labels.where("quality = 1 and doc_id % 5 <> 0").select("doc_id")
    scored = lm_scoring.score(table(spark, MIDDLE, "documents"), shown, hand_back=True).join(labels, "doc_id").where("quality = 0 or doc_id % 5 = 0")
    means = {r.quality: r.m for r in scored.groupBy("quality").agg(F.avg("score").alias("m")).collect()}
    assert means[1] < means[0]


def plain_letters(text):
    return " " + " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()) + " "


def plain_grams(s):
    return Counter(g for n in (1, 2, 3) for i in range(len(s) - n + 1) if (g := s[i : i + n]) != " ")


def test_language_id_by_brute_force(spark):
    """The whole query against profiles and distances worked out gram by gram."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    held = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in docs}
    fitted = {}
    for lang, text in {(r.lang, r.text) for r in docs if r.lang is not None and r.text is not None and not held[r.doc_id]}:
        fitted.setdefault(lang, Counter()).update(plain_grams(plain_letters(text)))
    profiles = {lang: {g: k for k, (g, _) in enumerate(sorted(c.items(), key=lambda x: (-x[1], x[0]))[:400])} for lang, c in sorted(fitted.items())}
    seen = {c for count in fitted.values() for g in count for c in g}
    place = {c: k for k, c in enumerate(sorted(seen - {" "}), 1)} | {" ": 0}
    assert len(place) <= language_id.ALPHABET
    got = {r.doc_id: r for r in language_id.op6_rank_order_language_id(spark, "/root/testdata/sf0.001").collect()}
    for r in docs:
        s = plain_letters(r.text or "")
        if not set(s) <= set(place):
            continue  # letters that no profile has share one code
        if not s.strip():
            assert (got[r.doc_id].lang_pred, got[r.doc_id].score) == ("und", 0.0)
            continue
        own = sorted(plain_grams(s).items(), key=lambda x: (-x[1], len(x[0]), [place[c] for c in x[0]]))[:300]
        d = {lang: sum(abs(p[g] - k) if g in p else 400 for k, (g, _) in enumerate(own)) for lang, p in profiles.items()}
        first, second = sorted(d, key=lambda x: (d[x], x))[:2]
        assert (got[r.doc_id].lang_pred, got[r.doc_id].held_out) == (first, held[r.doc_id])
        assert abs(got[r.doc_id].score - (d[second] - d[first]) / d[second]) < 1e-12
