"""Language models, language identification and decontamination."""

import math
from collections import Counter

import pytest
from edge import clashing, documents, edge_rows
from pyspark.sql import functions as F

from linkspan.llm import decontamination, language_id, lm_scoring
from linkspan.llm.common import table

SMALL = "/root/testdata/sf0.001"


def brute(rows, good):
    texts = [(t or "").encode().lower().split() for _, t in rows]
    target = [w for (i, _), w in zip(rows, texts, strict=True) if i in good]
    vocabulary = {w for w, n in Counter(w for t in target for w in t).items() if n >= 2}
    inventory = {b for b, n in Counter(b for t in target for b in zip(t, t[1:], strict=False)).items() if n >= 3}

    def model(ts):
        one = Counter(w if w in vocabulary else None for t in ts for w in t)
        two = Counter(b for t in ts for b in zip(t, t[1:], strict=False) if b in inventory)
        total = sum(one.values())

        def loss(words):
            out = 0.0
            for k, w in enumerate(words):
                p = (one[w if w in vocabulary else None] + 1) / (total + len(vocabulary) + 1)
                if k:
                    v = words[k - 1] if words[k - 1] in vocabulary else None
                    p = (two[words[k - 1], w] + 5 * p) / (one[v] + 5)
                out -= math.log(p)
            return out / len(words)

        return loss

    a, b = model(target), model(texts)
    return [(len(w), a(w), b(w)) if w else (0, None, None) for w in texts]


@pytest.mark.parametrize("limit", [4_000_000, 0])
def test_losses_against_brute_force(spark, limit):
    rows = [(r.doc_id, r.text) for r in table(spark, SMALL, "documents").select("doc_id", "text").limit(60).collect()] + [(x[0], x[1]) for x in edge_rows()]
    good = {r[0] for r in rows[::3] if r[0] is not None}
    ids = spark.createDataFrame([(i,) for i in good] * 2 + [(None,)], "id long")
    out = lm_scoring.score(clashing(documents(spark, rows)), ids, broadcast_grams=limit).collect()
    want = brute(rows, good)
    key = lambda x: tuple(-1 if v is None else round(v, 6) for v in x)
    assert sorted(key((r.n_tokens, r.target_loss, r.background_loss)) for r in out) == sorted(map(key, want))
    assert all(r.score is None or math.isclose(r.score, r.target_loss - r.background_loss) for r in out)


def test_no_target_and_empty(spark):
    none = spark.createDataFrame([], "id long")
    assert [r.n_tokens for r in lm_scoring.score(documents(spark, [(1, "a b c")]), none).collect()] == [3]
    assert lm_scoring.score(documents(spark, []), none).count() == 0


def test_held_out_accuracy(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    got = language_id.op6_rank_order_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int"))).first()[0] > 0.97


def test_language_edges(spark):
    rows = [(i, "the cat and the dog are here", "en") for i in range(5)] + [(10 + i, "le chat et le chien sont là", "fr") for i in range(5)]
    model = language_id.fit(documents(spark, rows), "lang")
    df = clashing(documents(spark, edge_rows() + [(50, "1234 ... 😀"), (51, "le chien et le chat"), (52, "日本語")]))
    got = [(r.doc_id, r.lang_pred, r.score) for r in language_id.predict(df, model, keep=("doc_id",)).collect()]
    by = {i: (p, s) for i, p, s in got}
    assert len(got) == len(edge_rows()) + 3 and by[1][0] == by[2][0] == by[3][0] == by[50][0] == "und" and by[51][0] == "fr" and by[52][0] in ("en", "fr")
    assert all(0 <= s <= 1 for _, _, s in got)
    nothing = language_id.fit(documents(spark, []), "lang")
    assert {r.lang_pred for r in language_id.predict(df, nothing).collect()} == {"und"}


def bench(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "item_id long, text string")


QUESTION = "A train leaves Springfield at 60 km per hour and Alice waits 15 minutes before she follows with Robert for another 90 km"


def leaked(spark, docs, items):
    return {(r.doc_id, r.item_id) for r in decontamination.leaks(clashing(documents(spark, docs)), bench(spark, items)).collect()}


def test_exchanged_names_and_numbers_are_caught(spark):
    other = QUESTION.replace("Springfield", "Oakville").replace("60", "45").replace("Alice", "Maria").replace("15", "20").replace("Robert", "Jonas").replace("90", "30")
    mixed = QUESTION.replace("km per", "words here").replace("waits", "sings").replace("follows", "goes").replace("another", "no")
    docs = [(1, "Some text first. " + other + " and more text follows here."), (2, mixed), (3, QUESTION.upper()), (None, QUESTION), (5, None), (6, "")]
    assert leaked(spark, docs, [QUESTION, None, "", "too short"]) == {(1, 0), (3, 0), (None, 0)}


def test_slots_must_agree(spark):
    item = "First Alice gives 5 coins to the boy and then Alice takes 5 coins from him while Alice sees 5 coins fall"
    same = item.replace("Alice", "Maria").replace("5", "7")
    torn = "First Maria gives 1 coins to the boy and then Jonas takes 2 coins from him while Peter sees 3 coins fall"
    assert leaked(spark, [(1, same), (2, torn)], [item]) == {(1, 0)}


def test_short_items_and_window_edges(spark):
    docs = [(1, "x y alpha beta gamma delta epsilon z"), (2, "alpha beta gamma delta"), (3, "epsilon\nalpha beta gamma"), (4, "delta epsilon")]
    assert leaked(spark, docs, ["Alpha beta, gamma delta epsilon!"]) == {(1, 0)}


def test_wide_benchmark_takes_the_other_way(spark, monkeypatch):
    docs = [(1, "aa bb cc dd ee ff gg hh ii jj"), (2, "nothing of that kind is here at all today")]
    monkeypatch.setattr(decontamination, "BROADCAST_WINDOWS", 0)
    assert leaked(spark, docs, ["aa bb cc dd ee ff gg hh ii jj"]) == {(1, 0)}


def test_all_verbatim_passages_are_found(spark):
    import re

    docs = [(r.doc_id, r.text) for r in table(spark, "/root/testdata/sf0.01", "documents").collect()]
    items = [(r.item_id, r.text) for r in table(spark, "/root/testdata/sf0.01", "benchmark").collect()]
    tokens = lambda t: [w for w in (re.sub(r"^[\W_]+|[\W_]+$", "", x).lower() for x in (t or "").split()) if w]
    lines = {d: " " + " ".join(tokens(t)) + " " for d, t in docs}
    whole = {(d, i) for i, t in items for d, line in lines.items() if " " + " ".join(tokens(t)) + " " in line}
    got = {(r.doc_id, r.item_id) for r in decontamination.op5_template_decontamination(spark, "/root/testdata/sf0.01").collect()}
    assert whole and whole <= got


def test_clean(spark):
    df = clashing(documents(spark, edge_rows() + [(70, QUESTION)]))
    out = decontamination.clean(df, bench(spark, [QUESTION]))
    assert out.columns == df.columns and out.count() == len(edge_rows())
    assert decontamination.clean(df, bench(spark, [])).count() == df.count() and decontamination.leaks(documents(spark, []), bench(spark, [QUESTION])).count() == 0
