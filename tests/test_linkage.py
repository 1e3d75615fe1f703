import itertools
import shutil
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkspan.functions import similarity
from linkspan.operators import blocking, features, integrity, metrics, models, sampling
from linkspan.operators.keys import keys
from linkspan.plans import linkage
from linkspan.plans.queries import TREE_COLUMNS, fixed_trees
from linkspan.sources import records

RECORD = "entity_id string, business_name string, business_address string, country string, source int"


def prepared(spark, rows):
    return records.split_sources(records.prepare(spark.createDataFrame(rows, RECORD), keep=("source",)))


def common(spark):
    rows = [(f"S2-{i}", "Common Business", "Same Address Road", "US", 2) for i in range(105)] + [("S3-x", "Common Business", "22 Uniquelane Address Road", "US", 3)]
    asked = [("S1-a", "Common Business", "Same Address Road", "US", 1), ("S1-b", "Common Business", "22 Uniquelane Address Road", "US", 1), ("S1-c", "Other Firm", "", "France", 1)]
    return prepared(spark, rows + asked)


def test_common_buckets_go_whole_and_rare_ones_stay(spark):
    refs, targets = common(spark)
    got = {(r.eid, r.tid) for r in blocking.pool(blocking.postings(refs, "eid"), blocking.postings(targets, "tid")).collect()}
    q = {r.eid: set(r.k) for r in refs.select("eid", keys(refs).alias("k")).collect()}
    t = {r.tid: set(r.k) for r in targets.select("tid", keys(targets).alias("k")).collect()}
    sizes = {}
    for k in itertools.chain.from_iterable(t.values()):
        sizes[k] = sizes.get(k, 0) + 1
    want = {(e, x) for e in q for x in t if any(sizes[k] <= 100 for k in q[e] & t[x])}
    assert got == want and ("S1-b", "S3-x") in got and not any(e == "S1-a" and x.startswith("S2") for e, x in got)


def test_rank_ties(spark):
    refs, targets = prepared(spark, [("S1-a", "Acme Widgets", "", "US", 1)] + [(f"S2-{i}", "Acme Widgets", "", "US", 2) for i in range(5)])
    found = blocking.pool(blocking.postings(refs, "eid"), blocking.postings(targets, "tid"))
    got = blocking.rank(found, refs, targets, prefilter=3, limit=2).orderBy("rank").collect()
    assert [r.tid for r in got] == ["S2-2", "S2-3"]  # the prefilter keeps the highest ids, the rank puts the lowest first


def test_features_of_empty_records(spark):
    refs, targets = prepared(spark, [("S1-a", "", "", "France", 1), ("S2-a", "", "", "France", 2)])
    pairs = blocking.attach(refs.select("eid").crossJoin(targets.select("tid")), refs, targets)
    r = features.with_features(pairs).select(*features.FEATURES).first()
    assert [r[i] for i in (0, 3, 7, 9)] == [0, 0, 0, 0] and [r[i] for i in (14, 15, 16)] == [1, 1, 1] and len(r) == 23


def test_blocking_recall(spark):
    entities = spark.createDataFrame([("a", "US"), ("b", "US")], "eid string, country string")
    truth = spark.createDataFrame([("a", "x"), ("a", "y")], "eid string, tid string")
    ranked = spark.createDataFrame([("a", "x", 1), ("a", "z", 2)], "eid string, tid string, rank int")
    sizes = spark.createDataFrame([("US", 100)], "country string, targets long")
    r = metrics.blocking_recall(entities, truth, ranked, (10,), sizes).where("country = 'all'").first()
    assert (r.pair_recall, r.mean_entity_recall, r.singleton_entities, r.average_candidates, r.reduction_ratio) == (0.5, 0.5, 1, 1.0, 0.99)


def test_macro_f05(spark):
    entities = spark.createDataFrame([(x, "US") for x in "abcd"], "eid string, country string")
    truth = spark.createDataFrame([("a", "x"), ("a", "y"), ("d", "q")], "eid string, tid string")
    scored = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 1.0), ("a", "z", 1.0), ("c", "z", 1.0)], "eid string, tid string, score double")
    r = metrics.matcher_evaluation(metrics.matcher_counts(entities, truth, scored, [0.5])).where("country = 'all'").first()
    assert r.macro_f05 == round((5 / 7 + 1) / 4, 6) and (r.tp, r.fp, r.fn, r.singleton_false_positive) == (2, 2, 1, 1) and r.blocking_recall == round(2 / 3, 6)


def test_thresholds():
    t = metrics.model_thresholds()
    assert len(t) == 41 and 0.7750000000000002 in t and len(metrics.heuristic_thresholds()) == 69


def test_end_to_end(spark):
    refs, targets = prepared(spark, [
        ("S1-a", "Alpha Works", "1 First Street", "US", 1), ("S1-b", "Beta Shop", "", "France", 1), ("S1-c", "Gamma Foods Ltd", "9 Hill Road", "India", 1),
        ("S2-a", "alpha works inc", "1 First St", "US", 2), ("S3-c", "Gamma Foods", "9 Hill Rd", "India", 3), ("S3-d", "Delta", "", "US", 3),
    ])
    got = {r.eid: (r.candidate_entity_ids, r.matched_entity_ids) for r in linkage.match_exact(refs, targets).collect()}
    assert {e: m for e, (_, m) in got.items()} == {"S1-a": "S2-a", "S1-b": "", "S1-c": "S3-c"}
    assert all(set(m.split(",")) <= set(c.split(",")) for c, m in got.values() if m)


def test_model_and_its_export_agree(spark):
    rng = np.random.default_rng(1)
    x = rng.random((400, 3))
    rows = [(float(a), float(b), float(c), float(a + b > 1)) for a, b, c in x]
    df = spark.createDataFrame(rows, "u double, v double, w double, label double")
    pairs = models.assemble(df, ("u", "v", "w"))
    model = models.train(pairs, models.Config(4, 3, 5))
    trees = models.export(model)
    scored = models.score_trees(models.predict(model, pairs), trees, ("u", "v", "w"), "exported").collect()
    assert max(abs(r.score - r.exported) for r in scored) < 1e-12
    as_sql = models.predict(model, pairs).withColumn("e", models.as_expression(trees, ("u", "v", "w"))).collect()
    assert max(abs(r.score - r.e) for r in as_sql) < 1e-12
    both = models.score_trees(models.predict(model, pairs), trees, ("u", "v", "w"), "exported")
    assert models.disagreements(both, "score", "exported", 0.5).count() == 0 and models.disagreements(both.withColumn("exported", F.col("exported") + 1e-9), "score", "exported", 0.5).count() == 400


def test_trees_with_missing_values(spark, tmp_path):
    trees = fixed_trees()
    models.write_trees(spark, trees, str(tmp_path / "t"))
    again = models.read_trees(spark, str(tmp_path / "t"))
    rows = spark.createDataFrame([(None, 0.1, 5.0), (30.0, 0.01, 5.0), (1.0, 0.2, 99999.0)], ", ".join(f"{c} double" for c in TREE_COLUMNS))
    got = models.score_trees(rows.withColumn("e", models.as_expression(trees, TREE_COLUMNS)), again, TREE_COLUMNS).collect()
    assert all(abs(r.e - r.score) < 1e-12 for r in got)


def test_selection_needs_precision(spark):
    rows = [(f"e{i}", f"t{i}", float(i % 2), float(i % 2)) for i in range(60)]
    pairs = models.assemble(spark.createDataFrame(rows, "eid string, tid string, f double, label double"), ("f",))
    entities = pairs.select("eid", F.lit("US").alias("country"))
    truth = pairs.where("label = 1").select("eid", "tid")
    _, config, threshold = models.select(pairs, pairs, entities, truth, (models.Config(2, 2, 1),))
    assert 0.05 <= threshold <= 0.999 and config.iterations == 2


def test_splits(spark):
    df = spark.range(100).select(F.col("id").cast("string").alias("id"))
    s = sampling.bottom_k(df, "id", "x", 30)
    parts = {r.split: r["count"] for r in sampling.positional_split(s, {"a": 10, "b": 5}).groupBy("split").count().collect()}
    assert parts == {"a": 10, "b": 5} and sampling.exclude(df, s, "id").count() == 70


def test_bad_outputs_are_named(spark):
    lists = "eid string, pos int, ids array<string>"
    source = spark.createDataFrame([("S1-a", 0), ("S1-b", 1)], "eid string, pos int")
    c = spark.createDataFrame([("S1-a", 0, ["S2-x", "S2-x"]), ("S1-b", 2, ["S1-y"])], lists)
    m = spark.createDataFrame([("S1-a", 0, ["S3-z"]), ("S1-b", 1, [])], lists)
    got = {r.eid: (r.misaligned, r.repeated, r.wrong_source, r.beyond_candidates) for r in integrity.output_checks(source, c, m).collect()}
    assert got == {"S1-a": (False, True, False, True), "S1-b": (True, False, True, False)}


def test_plan_of_candidates(spark):
    refs, targets = common(spark)
    plan = blocking.candidates(refs, targets)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan and "WindowGroupLimit" in plan
    assert plan.index("ArrowEvalPython") < plan.rindex("WindowGroupLimit")


def docs_sides(spark):
    raw = records.from_documents(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    return raw, *records.split_sources(records.prepare(raw, keep=("source",)))


def plain_ratio(x, y):
    return 0.0 if not x or not y else 1.0 if x == y else SequenceMatcher(None, x, y, autojunk=False).ratio()


def plain_jaccard(a, b):
    return len(set(a) & set(b)) / len(set(a) | set(b)) if a or b else 0.0


def plain_score(a, b):
    """The full score by its definition, over rows of plain Python."""
    name = max(plain_jaccard(a.nt, b.nt), plain_ratio(a.compact, b.compact))
    place = plain_jaccard(a.at, b.at)
    numbers = [[t for t in r.at if t.isdecimal()] for r in (a, b)]
    return 3 * max(name, place) + min(name, place) + 0.3 * plain_jaccard(*numbers)


def test_candidates_by_brute_force(spark):
    """The ranked lists, their scores and the three features that SQL cannot express, against difflib over the whole pool."""
    _, refs, targets = docs_sides(spark)
    pool = blocking.pool(blocking.postings(refs, "eid"), blocking.postings(targets, "tid")).collect()
    a, b = ({r[0]: r for r in df.collect()} for df in (refs.select("eid", "name", "compact", "nt", "at"), targets.select("tid", "name", "compact", "nt", "at")))
    by = {}
    for p in pool:
        x, y = a[p.eid], b[p.tid]
        name = max(plain_jaccard(x.nt, y.nt), float(x.compact == y.compact and x.compact != ""))
        place = plain_jaccard(x.at, y.at)
        by.setdefault(p.eid, []).append((3 * max(name, place) + min(name, place), p.tid))
    for limit in (3, 100):
        want = {}
        for e, rows in by.items():
            kept = sorted(rows, reverse=True)[:500]
            scored = sorted(((-plain_score(a[e], b[t]), t) for _, t in kept))[:limit]
            want |= {(e, t): (k, -s) for k, (s, t) in enumerate(scored, 1)}
        got = {(r.eid, r.tid): (r.rank, r.score) for r in blocking.candidates(refs, targets, limit=limit).collect()}
        assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-9 for k in want)
    for r in linkage.candidate_features(refs, targets).collect():
        x, y = a[r.eid], b[r.tid]
        assert abs(r.name_ratio - plain_ratio(x.compact, y.compact)) < 1e-12 and abs(r.ranking_score - plain_score(x, y)) < 1e-9
        assert abs(r.address_ratio - plain_ratio(" ".join(x.at), " ".join(y.at))) < 1e-12


def test_first_version_scores_by_brute_force(spark):
    rows = [("S1-a", "Müller & Söhne.com", "1 Rd", "DE", 1), ("S1-b", "", "", "DE", 1), ("S2-a", "muller and sohne", "1 Rd", "DE", 2), ("S2-b", "Muller Söhne", "", "DE", 2), ("S3-c", "", "2", "DE", 3)]
    refs, targets = records.split_sources(records.prepare_v1(spark.createDataFrame(rows, RECORD), keep=("source",)))
    pairs = blocking.attach(refs.select("eid").crossJoin(targets.select("tid")), refs, targets)
    for r in pairs.withColumn("s", similarity.score_v1("a", "b")).collect():
        x, y = r.a, r.b
        ratio = 1.0 if not x.name and not y.name else plain_ratio(x.name, y.name)
        assert abs(r.s - (3 * plain_jaccard(x.nt, y.nt) + plain_jaccard(x.at, y.at) + 2 * (x.name == y.name) + ratio)) < 1e-12
    assert {r.eid: r.a.name for r in pairs.collect()} == {"S1-a": "muller and sohne com", "S1-b": ""}


def test_a_trained_model_from_records_to_lists(spark, tmp_path):
    """Training, choice, freezing, inference through match() by the model and by its frozen trees."""
    raw, refs, targets = docs_sides(spark)
    truth = raw.where("source = 1").select(F.col("entity_id").alias("eid"), "text_hash").join(raw.where("source <> 1").select(F.col("entity_id").alias("tid"), "text_hash"), "text_hash").select("eid", "tid")
    features_path, frozen = str(tmp_path / "features"), str(tmp_path / "frozen")
    labelled = sampling.holdout(linkage.label(linkage.candidate_features(refs, targets), truth), "eid", "s")
    linkage.store_features(labelled.withColumn("split", F.when(F.col("held_out"), "tune").otherwise("train")), features_path)
    pairs = {n: models.assemble(linkage.load_features(spark, features_path, n)) for n in ("train", "tune")}
    assert pairs["train"].count() + pairs["tune"].count() == labelled.count()
    with pytest.raises(ValueError):
        linkage.store_features(labelled, features_path)
    entities = sampling.holdout(refs.select("eid", "country"), "eid", "s").where("held_out")
    with pytest.raises(ValueError):
        models.thaw(spark, frozen)
    model, config, threshold = models.select(pairs["train"], pairs["tune"], entities, truth.join(entities, "eid", "left_semi"), (models.Config(3, 3, 5), models.Config(6, 3, 5)), floor=0.0)
    models.freeze(spark, frozen, model, config, threshold)
    with pytest.raises(FileExistsError):
        models.freeze(spark, frozen, model, config, 0.1)
    trees, again, kept = models.thaw(spark, frozen)
    assert (again, kept) == (config, threshold)
    ranked = blocking.candidates(refs, targets).cache()
    for least in (threshold, 0.0):
        by_model = {r.eid: r for r in linkage.match(refs, targets, linkage.by_model(model), least, ranked).collect()}
        by_trees = {r.eid: r for r in linkage.match(refs, targets, linkage.by_trees(trees), least, ranked).collect()}
        assert by_model == by_trees and len(by_model) == refs.count()
        assert all(set(filter(None, r.matched_entity_ids.split(","))) <= set(r.candidate_entity_ids.split(",")) for r in by_model.values())
    assert any(r.matched_entity_ids for r in by_model.values()) and all(r.matched_entity_ids == r.candidate_entity_ids for r in by_model.values())


def test_the_whole_grid(spark):
    """All configurations, a tenth of their iterations each, with the floor as it is declared."""
    rows = [(f"e{i}", f"t{i}", float(i % 7), float(i % 7 > 3)) for i in range(400)]
    pairs = models.assemble(spark.createDataFrame(rows, "eid string, tid string, f double, label double").coalesce(1), ("f",)).cache()
    truth = pairs.where("label = 1").select("eid", "tid")
    _, config, threshold = models.select(pairs, pairs, pairs.select("eid", F.lit("US").alias("country")), truth, tuple(models.Config(c.iterations // 10, c.depth, c.least_rows) for c in models.GRID))
    assert config.iterations in (15, 30, 25) and 0.05 <= threshold <= 0.999


def test_index(spark, tmp_path):
    refs, targets = common(spark)
    path = str(tmp_path / "index")
    linkage.build_index(targets, path)
    want = {tuple(r) for r in blocking.pool(blocking.postings(refs, "eid"), blocking.postings(targets, "tid")).collect()}
    assert {tuple(r) for r in linkage.probe(refs, spark, path).collect()} == want
    shutil.rmtree(f"{path}/whole")
    with pytest.raises(ValueError, match="not whole"):
        linkage.open_index(spark, path)
    linkage.build_index(targets, path)
    linkage.build_index(targets.limit(3), str(tmp_path / "other"))
    shutil.rmtree(f"{path}/postings")
    shutil.copytree(tmp_path / "other" / "postings", f"{path}/postings")
    with pytest.raises(ValueError, match="hold"):
        linkage.open_index(spark, path)


def test_missing_records_fail(spark):
    refs, targets = common(spark)
    pairs = spark.createDataFrame([("S1-a", "S2-1"), ("S1-a", "S2-none")], "eid string, tid string")
    with pytest.raises(Exception, match="no record S2-none"):
        blocking.attach(pairs, refs, targets, strict=True).collect()
    assert blocking.attach(pairs.limit(1), refs, targets, strict=True).count() == 1
    with pytest.raises(ValueError, match="S2-none"):
        integrity.require(pairs, targets, "tid", "targets")
    assert integrity.require(pairs.limit(1), targets, "tid", "targets").count() == 1
