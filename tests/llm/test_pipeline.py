import re

from edge import documents, edge_rows
from test_ngram_join import brute as components
from test_packing import check as check_pieces
from test_spans import base_pii, bootstrap_brute

import corpus_pipeline
from linkspan.llm.common import scratch_paths, table
from linkspan.llm.decontamination import leaks

SMALL = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_and_take_effect(spark):
    docs = table(spark, SMALL, "documents")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "near_dups", "leaks", "pii", "packing"]
    one = stages["quality"](spark, docs, SMALL)
    assert one.dtypes == docs.dtypes
    from linkspan.llm.quality import op2_line_frequency_quality

    assert {r.doc_id for r in one.collect()} == {r.doc_id for r in op2_line_frequency_quality(spark, SMALL).where("kept").collect()}
    two = stages["near_dups"](spark, one, SMALL)
    groups = components([(r.doc_id, r.text) for r in one.collect()], 80, 5)
    assert two.dtypes == docs.dtypes and {r.doc_id for r in two.collect()} == {c for _, n, c in groups}
    three = stages["leaks"](spark, two, SMALL)
    gone = {r.doc_id for r in leaks(two, table(spark, SMALL, "benchmark")).collect()}
    assert three.dtypes == docs.dtypes and {r.doc_id for r in three.collect()} == {r.doc_id for r in two.collect()} - gone
    four = stages["pii"](spark, three, SMALL)
    assert four.dtypes == docs.dtypes and four.count() == three.count() and not four.where("text rlike '[A-Za-z0-9]@mail[0-9].example'").count()
    five = stages["packing"](spark, four, SMALL)
    assert {r.doc_id for r in five.collect()} == {r.doc_id for r in four.collect()}


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_line(line):
    return " ".join(WORD.findall(re.sub("[0-9]+", "0", "".join(c.lower() if "A" <= c <= "Z" else c for c in line))))


def repeated(words):
    where = {}
    for i in range(len(words) - 4):
        where.setdefault(tuple(words[i : i + 5]), []).append(i)
    return len({i + k for at in where.values() if len(at) > 1 for i in at for k in range(5)})


def cleaned(rows):
    """What the line rules leave of (doc_id, text, source)."""
    texts, held = {}, {}
    for _, t, s in rows:
        if (t or "") not in texts.setdefault(s, set()):
            texts[s].add(t or "")
            for line in {plain_line(x) for x in (t or "").split("\n") if WORD.search(x)}:
                held[s, line] = held.get((s, line), 0) + 1
    common = {k for k, n in held.items() if n > max(20, 0.02 * len(texts[k[0]]))}
    out = []
    for i, t, s in rows:
        words = WORD.findall(t or "")
        kept = [x for x in (t or "").split("\n") if not WORD.search(x) or (s, plain_line(x)) not in common]
        left = sum(len(WORD.findall(x)) for x in kept)
        if len(words) >= 10 and 100 * repeated(words) <= 20 * len(words) and left >= 10 and len(words) - left <= 0.8 * len(words):
            out.append((i, "\n".join(kept)))
    return out


def redacted(rows):
    found = bootstrap_brute(rows)
    out = []
    for i, t in rows:
        spans = sorted([(s, e, k) for k, s, e in base_pii(t)] + [(s, e, "found") for d, s, e in found if d == i])
        text, at = "", 0
        for s, e, k in spans:
            if s >= at:
                text += t[at:s] + f"<{k}>"
            at = max(at, e)
        out.append((i, text + t[at:]))
    return out


def test_run_by_brute_force(spark):
    rows = [(r.doc_id, r.text, r.source) for r in table(spark, SMALL, "documents").collect()]
    one = cleaned(rows)
    first = {c for _, _, c in components(one, 80, 5)}
    two = [r for r in one if r[0] in first]
    gone = {r.doc_id for r in leaks(documents(spark, two), table(spark, SMALL, "benchmark")).collect()}
    four = redacted([r for r in two if r[0] not in gone])
    before = scratch_paths()
    out = corpus_pipeline.run(spark, SMALL)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    pieces = out.withColumn("uid", out["doc_id"]).collect()
    full, n = check_pieces(four, pieces, 4096)
    assert full >= n - 1 and len(one) < len(rows) and len(two) < len(one) and any(a != b for a, b in zip(four, two, strict=False))
    assert len(scratch_paths() - before) <= 2  # the last stage's documents and their ids


def test_edges(spark):
    for rows in ([], edge_rows()):
        docs = documents(spark, rows)
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SMALL)
            assert name == "packing" or docs.columns == columns
        # of the edge rows only the long ones have ten words, and one of each group stays
        assert {r.doc_id for r in docs.collect()} == ({5} if rows else set())
