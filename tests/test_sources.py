import pytest

from linkspan.sources import records
from linkspan.streaming.inference import stream_matches

HEADER = "entity_id\tbusiness_name\tbusiness_address\tcountry\n"


def test_tsv_rules(spark, tmp_path):
    p = tmp_path / "a.tsv"
    p.write_text(HEADER + 'S1-a\t"Quote ""x"" Ltd"\t\tUS\nS1-b\tB\t1 Road\t\n')
    got = [tuple(r) for r in records.read_tsv(spark, str(p)).orderBy("entity_id").collect()]
    assert got == [("S1-a", 'Quote "x" Ltd', "", "US"), ("S1-b", "B", "1 Road", "")]


@pytest.mark.parametrize("body", [HEADER + "S1-a\tA\tB\n", HEADER + "S1-a\tA\tB\tUS\tmore\n", "id\tbusiness_name\tbusiness_address\tcountry\nS1-a\tA\tB\tUS\n"])
def test_bad_files_fail(spark, tmp_path, body):
    p = tmp_path / "a.tsv"
    p.write_text(body)
    with pytest.raises(Exception):  # noqa: B017
        records.read_tsv(spark, str(p)).collect()


def test_splits_truth_and_samples(spark, tmp_path):
    (tmp_path / "train").mkdir()
    for n in (1, 2, 3):
        (tmp_path / "train" / f"train_source{n}.tsv").write_text(HEADER + f"S{n}-a\tA\tB\tUS\n")
    assert {(r.entity_id, r.source) for r in records.read_split(spark, str(tmp_path), "train").collect()} == {("S1-a", 1), ("S2-a", 2), ("S3-a", 3)}
    (tmp_path / "t.tsv").write_text("source1_entity_id\tmatched_entity_ids\nS1-a\tS2-a,S3-a\nS1-b\t\n")
    assert {r.eid: r.matched for r in records.read_truth(spark, str(tmp_path / "t.tsv")).collect()} == {"S1-a": ["S2-a", "S3-a"], "S1-b": []}
    (tmp_path / "s.tsv").write_text("source1_entity_id\tsplit\nS1-a\tdevelopment\n")
    (tmp_path / "c.tsv").write_text("source1_entity_id\tcandidate_entity_ids\nS1-a\tS2-b,S2-a\n")
    _, ranked = records.read_sample(spark, str(tmp_path / "s.tsv"), str(tmp_path / "c.tsv"))
    assert [(r.rank, r.tid) for r in ranked.orderBy("rank").collect()] == [(1, "S2-b"), (2, "S2-a")]
    for split, n in (("development", 1), ("test", 0)):
        rows, ranked = records.read_sample(spark, str(tmp_path / "s.tsv"), str(tmp_path / "c.tsv"), split)
        assert (rows.count(), ranked.count()) == (n, 2 * n)


def test_reports_and_samples_are_written(spark, tmp_path):
    rows = spark.createDataFrame([("b", 2), ("a", 1)], "id string, n int")
    records.write_report(rows.orderBy("id"), str(tmp_path / "r"))
    records.write_sample(rows, str(tmp_path / "s"))
    assert sorted(spark.read.json(str(tmp_path / "r")).select("id", "n").collect()) == [("a", 1), ("b", 2)]
    assert next((tmp_path / "s").glob("*.csv")).read_text() == "id\tn\na\t1\nb\t2\n"


def test_lists_keep_order_and_empties(spark, tmp_path):
    entities = spark.createDataFrame([("S1-b", 0), ("S1-a", 1)], "eid string, pos int")
    pairs = spark.createDataFrame([("S1-a", "S2-y", 2), ("S1-a", "S2-x", 1)], "eid string, tid string, rank int")
    lists = records.id_lists(entities, pairs).coalesce(1)
    records.write_lists(lists, str(tmp_path / "out"), "matched_entity_ids")
    text = next((tmp_path / "out").glob("*.csv")).read_text()
    assert text == "source1_entity_id\tmatched_entity_ids\nS1-b\t\nS1-a\tS2-x,S2-y\n"
    assert {r.eid: r.ids for r in records.read_lists(spark, str(tmp_path / "out")).collect()} == {"S1-b": [], "S1-a": ["S2-x", "S2-y"]}


def test_fingerprint(spark, tmp_path):
    import hashlib

    (tmp_path / "a.tsv").write_bytes(b"abc")
    r = records.fingerprint(spark, str(tmp_path), "*.tsv").first()
    assert (r.file, r.bytes, r.sha256) == ("a.tsv", 3, hashlib.sha256(b"abc").hexdigest())


def test_stream_restarts_without_repeats(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    targets = records.prepare(spark.createDataFrame([("S2-a", "Alpha Works", "", "US"), ("S3-b", "Beta Shop", "", "US")], records.SCHEMA)).withColumnRenamed("entity_id", "tid")
    out = str(tmp_path / "out")
    for name, row in (("1.tsv", "S1-a\tAlpha Works Ltd\t\tUS\n"), ("2.tsv", "S1-b\tNobody\t\tUS\n")):
        (source / name).write_text(HEADER + row)
        q = stream_matches(spark, str(source), targets, out, str(tmp_path / "cp"))
        q.awaitTermination()
    got = {r.eid: r.matched_entity_ids for r in spark.read.parquet(out).collect()}
    assert got == {"S1-a": "S2-a", "S1-b": ""} and spark.read.parquet(out).count() == 2
