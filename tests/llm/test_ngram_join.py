import random

from edge import clashing, documents, edge_rows

from linkspan.llm import graph, ngram_join
from linkspan.llm.common import materialise, numbered


def brute(rows, percent=90, width=3):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                label[root(i)] = root(j)
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(root(i), []).append(r[0])
    return sorted(((r[0], len(s), min((x for x in groups[root(i)] if x is not None), default=None) if s else r[0]) for i, (r, s) in enumerate(zip(rows, sets, strict=True))), key=repr)


def same(spark, rows, rules=((90, 3), (80, 5))):
    for percent, width in rules:
        got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.link(documents(spark, rows), percent=percent, width=width).collect()), key=repr)
        assert got == brute([r[:2] for r in rows], percent, width)


def test_edges(spark):
    same(spark, [r for r in edge_rows()])
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.link(clashing(documents(spark, edge_rows()))).collect()), key=repr)
    assert got == brute([r[:2] for r in edge_rows()])


def test_chains_and_near_copies(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(12):
        text = rng.choices(words, k=rng.randint(3, 200))
        for _ in range(rng.randint(1, 12)):
            rows.append((rng.randint(0, 10_000), " ".join(text)))
            text = list(text)
            for _ in range(rng.randint(0, 3)):
                text[rng.randrange(len(text))] = rng.choice(words)
    rows += [(20_000 + i, " ".join(rng.choices(words[:6], k=4))) for i in range(80)]
    same(spark, rows)


def test_near_copies_of_one_text(spark, monkeypatch):
    """A large group in which few pairs link directly: leads alone do not join it, and its buckets are dealt out by blocks."""
    monkeypatch.setattr(ngram_join, "BLOCK", 7)
    monkeypatch.setattr(ngram_join, "FIRST_PART", 3)
    rng = random.Random(8)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(90):
        text = list(base)
        for k in rng.sample(range(120), rng.choice((1, 2, 3, 4))):
            text[k] = f"x{rng.randrange(900)}"
        rows.append((i, " ".join(text)))
    same(spark, rows)


def test_pairs_follow_the_members_of_a_group(spark, monkeypatch):
    """A large group of near copies of which a part links makes some pairs a copy, and not a part of all its pairs (161,912 here, when they met in two parts)."""
    made = []

    def counted(pairs, traits, percent, f=ngram_join._verified):
        pairs = materialise(pairs)
        made.append(pairs.count())
        return f(pairs, traits, percent)

    monkeypatch.setattr(ngram_join, "_verified", counted)
    rng = random.Random(9)
    base = [f"b{i}" for i in range(220)]
    rows = []
    for i in range(800):
        text = list(base)
        for k in rng.sample(range(220), 2):
            text[k] = f"x{i}y{k}"
        rows.append((i, " ".join(text)))
    same(spark, rows, [(90, 3)])
    assert sum(made) < 40 * len(rows)


def test_long_sets_meet_once(spark, monkeypatch):
    """Sets of more tokens than they carry meet at the least one that they share: a row a pair, before any distinct()."""
    monkeypatch.setattr(ngram_join, "CARRIED", 20)
    monkeypatch.setattr(ngram_join, "STARS", 0)
    rng = random.Random(10)
    rows = [(i, [k for k in range(60) if k != i]) for i in range(4)]
    dealt = [(t, 0, i, i, 40, *[0] * ngram_join.SKETCH, sorted(ts)[:12]) for i, ts in rows for t in rng.sample(ts, len(ts))]
    names = "token long, group long, uid long, component long, n long, " + ", ".join(f"k{i} long" for i in range(ngram_join.SKETCH)) + ", tokens array<long>"
    df = spark.createDataFrame(dealt, names)
    pairs = ngram_join._meeting(df, df, ("token", "group"), 90, ngram_join.F.col("a.component") < ngram_join.F.col("b.component"))
    assert pairs.count() == 6
    long = [(i, " ".join(f"w{k}" for k in range(600) if k != 40 * i)) for i in range(4)]
    made = []
    monkeypatch.setattr(ngram_join, "_meeting", lambda a, b, *rest, f=ngram_join._meeting: made.append(a.agg(ngram_join.F.max(ngram_join.F.size("tokens"))).first()[0]) or f(a, b, *rest))
    same(spark, long, [(90, 3)])
    assert made and max(x or 0 for x in made) == ngram_join.FEW


def test_a_path_is_joined_in_few_rounds(spark, monkeypatch):
    tables = []
    monkeypatch.setattr(graph, "materialise", lambda df, f=graph.materialise: tables.append(1) or f(df))
    edges = spark.createDataFrame([(i, i + 1) for i in range(1000)] + [(5000, 5001), (7, 7)], "a long, b long")
    label = {r.v: r.component for r in graph.components(edges).collect()}
    assert len(label) == 1003 and len({label[i] for i in range(1001)}) == 1 and label[5000] == label[5001] != label[0] and label[0] in range(1001)
    assert len(tables) <= 3 * 14  # two tables a round, and one on the way back


def test_readings_dealt_out_otherwise(spark):
    """Row numbers mean the same rows, whatever the number of splits of a reading."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    key, before = "spark.sql.leafNodeDefaultParallelism", spark.conf.get("spark.sql.leafNodeDefaultParallelism", None)
    read = {}
    try:
        for df in (docs, materialise(docs.repartition(7)), spark.createDataFrame(docs.limit(50).collect(), docs.schema)):
            rows = numbered(df, "uid")
            for n in ("1", "13"):
                spark.conf.set(key, n)
                read[n] = {(r.uid, r.doc_id) for r in rows.select("uid", "doc_id").collect()}
            assert read["1"] == read["13"] and len({u for u, _ in read["1"]}) == df.count()
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)


def test_a_common_passage_does_not_link(spark):
    rng = random.Random(4)
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, passage + " " + " ".join(f"u{i}x{k}" for k in range(rng.randint(1, 60)))) for i in range(200)]
    same(spark, rows, [(90, 3)])


def test_sizes_at_the_threshold(spark):
    rows = []
    for n in (10, 11, 19, 20, 29, 30, 100):
        base = [f"s{n}x{i}" for i in range(n + 2)]
        for d in range(1, 8):
            rows += [(n * 100 + d, " ".join(base)), (n * 100 + 50 + d, " ".join(base[: len(base) - d]))]
    same(spark, rows)


def test_one_of_each(spark):
    df = clashing(documents(spark, edge_rows()))
    out = ngram_join.one_of_each(df)
    assert out.columns == df.columns
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=repr)
    assert len([x for x in got if x[1] and "same words" in x[1].lower()]) == 1 and (1, None) in got and (2, "") in got


def test_empty(spark):
    assert ngram_join.link(documents(spark, [])).count() == 0 and ngram_join.one_of_each(documents(spark, [])).count() == 0
