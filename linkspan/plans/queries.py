"""The queries by name, each with its SQL where SQL can express it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkspan.functions import similarity as sim
from linkspan.functions import text
from linkspan.operators import blocking, integrity, metrics, models, sampling
from linkspan.operators.features import FEATURES, SEQUENCE_BASED, with_features
from linkspan.operators.keys import INNER, KINDS, KINDS_V1, SEP, keys
from linkspan.plans import linkage, sql
from linkspan.sources import records, scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
NATIVE = tuple(f for f in FEATURES if f not in SEQUENCE_BASED)
DOCS = (sql.DOCUMENTS, sql.PREPARED)
POOLED = (*DOCS, sql.RANKED, sql.ALL_KEYS, sql.POOL)


def query(name: str, oracle: str | None = None):
    def register(f):
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return register


def load(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def biz_docs(spark: SparkSession, sf: str) -> DataFrame:
    return records.from_documents(load(spark, sf, "documents"))


def biz_parts(spark: SparkSession, sf: str) -> DataFrame:
    return records.from_parts(load(spark, sf, "part"))


def sides(raw: DataFrame, prepare=records.prepare) -> tuple[DataFrame, DataFrame]:
    """Reference records and targets. Records are prepared once and written down: postings, buckets and attributes all read them."""
    return records.split_sources(scratch.written(prepare(raw, keep=("source",))))


def silver(raw: DataFrame) -> DataFrame:
    """Links between equal texts of one language, from source 1 to the others."""
    a = raw.where("source = 1").select(F.col("entity_id").alias("eid"), "text_hash", "lang")
    b = raw.where("source <> 1").select(F.col("entity_id").alias("tid"), "text_hash", "lang")
    return a.join(b, ["text_hash", "lang"]).select("eid", "tid")


def show_key(c) -> F.Column:
    return F.translate(c, SEP + INNER, "|+")


SHOW = "translate(key, chr(1) || chr(2), '|+')"

# ---- sources and scalar functions


@query("scan_audit", """select coalesce(lang, 'all') as country, count(*) as n_rows, sum((trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(13)) = '')::int)::bigint as blank_text,
  sum((coalesce(source, '') = '')::int)::bigint as blank_source, sum(strlen(coalesce(text, '')) + strlen(coalesce(source, '')))::bigint as bytes from documents group by grouping sets ((), (lang))""")
def scan_audit(spark, sf):
    return metrics.source_audit(load(spark, sf, "documents"), ("text", "source"), "lang")


@query("normalize_v2", f"select doc_id, {sql.normal('text')} as normal from documents")
def normalize_v2(spark, sf):
    return load(spark, sf, "documents").select("doc_id", text.normalize(F.col("text")).alias("normal"))


@query("normalize_v1", f"select doc_id, {sql.normal('text')} as normal from documents")
def normalize_v1(spark, sf):
    return load(spark, sf, "documents").select("doc_id", text.normalize(F.col("text"), version=1).alias("normal"))


@query("domain_strip", f"select page_id, {sql.domain('url')} as stripped, {sql.normal(sql.domain('url'))} as normal from pages")
def domain_strip(spark, sf):
    stripped = text.strip_domain(F.col("url"))
    return load(spark, sf, "pages").select("page_id", stripped.alias("stripped"), text.normalize(stripped).alias("normal"))


@query("prepare_tokens", sql.chain(*DOCS) + """ select entity_id, source, name, compact, array_to_string(nt, ' ') as nt, array_to_string("at", ' ') as "at", country from prep""")
def prepare_tokens(spark, sf):
    p = records.prepare(biz_docs(spark, sf), keep=("source",))
    return p.select("entity_id", "source", "name", "compact", F.array_join("nt", " ").alias("nt"), F.array_join("at", " ").alias("at"), "country")


@query("prepare_parties", sql.chain(sql.PARTIES, sql.PREPARED) + """ select entity_id, source, name, compact, len(nt) as n_name, len("at") as n_address, country from prep""")
def prepare_parties(spark, sf):
    raw = records.from_parties(load(spark, sf, "customer"), load(spark, sf, "supplier"), load(spark, sf, "nation"))
    p = records.prepare(raw, keep=("source",))
    return p.select("entity_id", "source", "name", "compact", F.size("nt").cast("long").alias("n_name"), F.size("at").cast("long").alias("n_address"), "country")


@query("char_grams", f"select p_partkey, len({sql.grams('p_name', 3)}) as n3, array_to_string(list_sort({sql.grams('p_name', 4)}), '|') as grams4 from part")
def char_grams(spark, sf):
    return load(spark, sf, "part").select("p_partkey", F.size(text.grams(F.col("p_name"), 3)).cast("long").alias("n3"), F.array_join(F.array_sort(text.grams(F.col("p_name"), 4)), "|").alias("grams4"))


@query("list_codec", """with l as (select l_orderkey, string_agg(l_partkey, ',' order by l_partkey) as ids from lineitem where l_returnflag = 'R' group by l_orderkey)
select o_orderkey, coalesce(ids, '') as ids, len(list_filter(string_split(coalesce(ids, ''), ','), lambda x: x <> '')) as n from orders left join l on o_orderkey = l_orderkey""")
def list_codec(spark, sf):
    items = load(spark, sf, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list("l_partkey")).alias("l"))
    ids = F.coalesce(text.list_encode(F.col("l").cast("array<string>")), F.lit(""))
    out = load(spark, sf, "orders").select("o_orderkey").join(items, "o_orderkey", "left").select("o_orderkey", ids.alias("ids"))
    return out.withColumn("n", F.size(text.list_decode(F.col("ids"))).cast("long"))


@query("id_prefixes", sql.chain(sql.PARTS) + " select source, sum(starts_with(entity_id, 'S' || source || '-')::int)::bigint as good, count(*) as n from raw group by source")
def id_prefixes(spark, sf):
    good = sum((F.when((F.col("source") == n) & integrity.id_prefix(F.col("entity_id"), n), 1).otherwise(0) for n in (1, 2, 3)), F.lit(0))
    return biz_parts(spark, sf).groupBy("source").agg(F.sum(good).cast("long").alias("good"), F.count(F.lit(1)).alias("n"))


@query("fingerprint")
def fingerprint(spark, sf):
    return records.fingerprint(spark, sf, "*.parquet")


# ---- blocking keys


def _keys(kind):
    def run(spark, sf):
        p = records.prepare(biz_docs(spark, sf))
        return p.select("entity_id", F.explode(keys(p, (kind,))).alias("key")).select("entity_id", show_key("key").alias("key"))

    return run


for _kind in KINDS:
    query(f"keys_{_kind}", sql.chain(*DOCS, sql.RANKED) + f", k as ({sql.KEY_SQL[_kind]}) select entity_id, {SHOW} as key from k")(_keys(_kind))
for _kind, _sql in sql.KEY_SQL_V1.items():
    query(f"keys_{_kind}_v1", sql.chain(*DOCS, sql.RANKED) + f", k as ({_sql}) select entity_id, {SHOW} as key from k")(_keys(_kind))


@query("key_frequency", sql.chain(*DOCS, sql.RANKED, sql.ALL_KEYS) + " select split_part(key, chr(1), 1) as kind, count(*) as postings, count(distinct key) as n_keys, max(n) as largest from (select key, count(*) over (partition by key) as n from keys) group by kind")
def key_frequency(spark, sf):
    p = records.prepare(biz_docs(spark, sf))
    sizes = p.select(F.explode(keys(p)).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    return sizes.groupBy(F.substring_index("key", SEP, 1).alias("kind")).agg(F.sum("n").alias("postings"), F.count(F.lit(1)).alias("n_keys"), F.max("n").alias("largest"))


def _postings(raw):
    refs, targets = sides(raw)
    return blocking.postings(refs, "eid"), blocking.postings(targets, "tid")


@query("dropped_keys", sql.chain(sql.PARTS, sql.PREPARED, sql.RANKED, sql.ALL_KEYS, sql.POOL) + f" select {SHOW} as key, n from size where n > 100")
def dropped_keys(spark, sf):
    return blocking.bucket_sizes(*_postings(biz_parts(spark, sf))).where(F.col("n") > blocking.CAP).select(show_key("key").alias("key"), "n")


@query("block_exact", sql.chain(*DOCS, sql.RANKED) + ", keys as (" + sql.KEY_SQL["exact"] + "), " + sql.POOL + " select eid, tid from pool")
def block_exact(spark, sf):
    refs, targets = sides(biz_docs(spark, sf))
    return blocking.pool(blocking.postings(refs, "eid", ("exact",)), blocking.postings(targets, "tid", ("exact",)))


@query("block_capped", sql.chain(*POOLED) + " select eid, tid from pool")
def block_capped(spark, sf):
    return blocking.pool(*_postings(biz_docs(spark, sf)))


@query("block_parts", sql.chain(sql.PARTS, sql.PREPARED, sql.RANKED, sql.ALL_KEYS, sql.POOL) + " select eid, tid from pool")
def block_parts(spark, sf):
    return blocking.pool(*_postings(biz_parts(spark, sf)))


@query("block_parties", sql.chain(sql.PARTIES, sql.PREPARED, sql.RANKED, sql.ALL_KEYS, sql.POOL) + " select eid, tid from pool")
def block_parties(spark, sf):
    return blocking.pool(*_postings(records.from_parties(load(spark, sf, "customer"), load(spark, sf, "supplier"), load(spark, sf, "nation"))))


@query("probe_restrict", sql.chain(*POOLED) + " select count(*) as n_keys, sum(n)::bigint as postings, sum((n > 100)::int)::bigint as dropped from size")
def probe_restrict(spark, sf):
    sizes = blocking.bucket_sizes(*_postings(biz_docs(spark, sf)))
    return sizes.agg(F.count(F.lit(1)).alias("n_keys"), F.sum("n").alias("postings"), metrics.count_where(F.col("n") > blocking.CAP).alias("dropped"))


# ---- scores, ranks and features


def _attached(spark, sf):
    refs, targets = sides(biz_docs(spark, sf))
    found = blocking.pool(blocking.postings(refs, "eid"), blocking.postings(targets, "tid"))
    return blocking.attach(found, refs, targets)


def _cheap(k):
    def run(spark, sf):
        scored = _attached(spark, sf).withColumn("cheap", sim.cheap_score("a", "b"))
        return blocking.top(scored, "cheap", k, ties_descending=True).select("eid", "tid", "rank", F.round("cheap", 6).alias("score"))

    return run


for _k in (10, 500):
    query(f"cheap_rank_{_k}", sql.chain(*POOLED, sql.PAIRS) + f" select eid, tid, row_number() over (partition by eid order by {sql.CHEAP} desc, tid desc) as rank, round({sql.CHEAP}, 6) as score from pairs qualify rank <= {_k}")(_cheap(_k))


FIRST = (sql.DOCUMENTS, sql.PREPARED_V1, sql.RANKED, sql.ALL_KEYS_V1, sql.POOL)


def _attached_v1(spark, sf):
    """The first version throughout: its normalisation, its keys, its pool."""
    refs, targets = sides(biz_docs(spark, sf), records.prepare_v1)
    found = blocking.pool(blocking.postings(refs, "eid", KINDS_V1), blocking.postings(targets, "tid", KINDS_V1))
    return blocking.attach(found, refs, targets)


@query("prepare_v1_tokens", sql.chain(sql.DOCUMENTS, sql.PREPARED_V1) + """ select entity_id, source, name, compact, array_to_string(nt, ' ') as nt, array_to_string("at", ' ') as "at", country from prep""")
def prepare_v1_tokens(spark, sf):
    p = records.prepare_v1(biz_docs(spark, sf), keep=("source",))
    return p.select("entity_id", "source", "name", "compact", F.array_join("nt", " ").alias("nt"), F.array_join("at", " ").alias("at"), "country")


@query("block_v1", sql.chain(*FIRST) + " select eid, tid from pool")
def block_v1(spark, sf):
    return _attached_v1(spark, sf).select("eid", "tid")


@query("cheap_rank_v1", sql.chain(*FIRST, sql.PAIRS) + f" select eid, tid, row_number() over (partition by eid order by {sql.CHEAP_V1} desc, tid desc) as rank, round({sql.CHEAP_V1}, 6) as score from pairs qualify rank <= 500")
def cheap_rank_v1(spark, sf):
    scored = _attached_v1(spark, sf).withColumn("cheap", sim.cheap_score_v1("a", "b"))
    return blocking.top(scored, "cheap", blocking.PREFILTER, ties_descending=True).select("eid", "tid", "rank", F.round("cheap", 6).alias("score"))


@query("sequence_ratio")
def sequence_ratio(spark, sf):
    ratio = sim.sequence_ratio(F.col("a.compact"), F.col("b.compact"))
    return _attached(spark, sf).select("eid", "tid", F.round(ratio, 6).alias("ratio"))


@query("score_v1")
def score_v1(spark, sf):
    return _attached_v1(spark, sf).select("eid", "tid", F.round(sim.score_v1("a", "b"), 6).alias("score"))


@query("fine_rank_100")
def fine_rank_100(spark, sf):
    refs, targets = sides(biz_docs(spark, sf))
    return blocking.candidates(refs, targets).select("eid", "tid", "rank", F.round("score", 6).alias("score"))


FEATURE_SQL = {
    "name_token_jaccard": sql.jaccard("ant", "bnt"), "name_token_containment": sql.containment("ant", "bnt"), "name_compact_equal": sql.EQUAL,
    "name_3gram_jaccard": sql.jaccard(sql.grams("ac", 3), sql.grams("bc", 3)), "name_4gram_jaccard": sql.jaccard(sql.grams("ac", 4), sql.grams("bc", 4)),
    "name_length_ratio": "(case when greatest(length(ac), length(bc)) = 0 then 0.0::double else least(length(ac), length(bc))::double / greatest(length(ac), length(bc)) end)",
    "address_token_jaccard": sql.jaccard("aat", "bat"), "address_token_containment": sql.containment("aat", "bat"),
    "number_jaccard": sql.jaccard(sql.digits("aat"), sql.digits("bat")),
    "number_equal": f"(len({sql.digits('aat')}) > 0 and {sql.digits('aat')} = {sql.digits('bat')})::int::double",
    "number_conflict": f"(len({sql.digits('aat')}) > 0 and len({sql.digits('bat')}) > 0 and len(list_intersect({sql.digits('aat')}, {sql.digits('bat')})) = 0)::int::double",
    "postcode_jaccard": sql.jaccard(sql.postal("aat"), sql.postal("bat")),
    "address_missing_query": "(len(aat) = 0)::int::double", "address_missing_target": "(len(bat) = 0)::int::double", "country_equal": "(aco = bco)::int::double",
    "name_digit_jaccard": sql.jaccard(sql.digits("ant"), sql.digits("bnt")),
    "name_ascii_query": "regexp_full_match(ac, '[[:ascii:]]*')::int::double", "name_ascii_target": "regexp_full_match(bc, '[[:ascii:]]*')::int::double",
    "name_tokens_query": "len(ant)::double", "name_tokens_target": "len(bnt)::double",
}
GROUPS = {"feature_token_sim": NATIVE[:8], "feature_numbers": tuple(f for f in NATIVE if "number" in f or "postcode" in f or "digit" in f), "feature_flags": tuple(f for f in NATIVE if "missing" in f or "country" in f or "ascii" in f or "tokens" in f)}


def _features(names):
    def run(spark, sf):
        return with_features(_attached(spark, sf), names).select("eid", "tid", *(F.round(n, 6).alias(n) for n in names))

    return run


for _group, _names in GROUPS.items():
    query(_group, sql.chain(*POOLED, sql.PAIRS) + " select eid, tid, " + ", ".join(f"round({FEATURE_SQL[n]}, 6) as {n}" for n in _names) + " from pairs")(_features(_names))


@query("features_full")
def features_full(spark, sf):
    refs, targets = sides(biz_docs(spark, sf))
    return linkage.candidate_features(refs, targets)


# ---- samples and splits


@query("hash_split_holdout", "select c_custkey, concat('0x', substr(sha256('2026:S1-' || c_custkey), 1, 8))::bigint % 5 = 0 as held_out from customer")
def hash_split_holdout(spark, sf):
    rows = load(spark, sf, "customer").select("c_custkey", F.concat(F.lit("S1-"), "c_custkey").alias("eid"))
    return sampling.holdout(rows, "eid", "2026").select("c_custkey", "held_out")


@query("hash_split_tuning", "select c_custkey, concat('0x', substr(sha256('matcher:2026:S1-' || c_custkey), 1, 8))::bigint % 5 = 0 as held_out from customer")
def hash_split_tuning(spark, sf):
    rows = load(spark, sf, "customer").select("c_custkey", F.concat(F.lit("S1-"), "c_custkey").alias("eid"))
    return sampling.holdout(rows, "eid", "matcher:2026").select("c_custkey", "held_out")


SAMPLE = "s as (select c_custkey, c_mktsegment, sha256('sample:' || c_custkey) as h from customer order by h, c_custkey limit 100)"


@query("bottom_k_sample", f"with {SAMPLE} select * from s")
def bottom_k_sample(spark, sf):
    return sampling.bottom_k(load(spark, sf, "customer").select("c_custkey", "c_mktsegment"), "c_custkey", "sample", 100)


@query("positional_split", f"with {SAMPLE} select c_custkey, case when pos <= 60 then 'train' when pos <= 75 then 'tune' else 'evaluation' end as split from (select c_custkey, row_number() over (order by h) as pos from s) where pos <= 90")
def positional_split(spark, sf):
    return sampling.positional_split(bottom_k_sample(spark, sf), {"train": 60, "tune": 15, "evaluation": 15}).select("c_custkey", "split")


@query("fresh_exclusion", f"with {SAMPLE} select c_custkey from customer anti join s using (c_custkey)")
def fresh_exclusion(spark, sf):
    return sampling.exclude(load(spark, sf, "customer").select("c_custkey"), bottom_k_sample(spark, sf), "c_custkey")


# ---- metrics

ENTITIES = "ent as (select o_orderkey as eid, o_orderpriority as country from orders)"
EVAL = (ENTITIES, "tru as (select distinct l_orderkey as eid, l_partkey as tid from lineitem where l_returnflag = 'R')",
        "cand as (select l_orderkey as eid, l_partkey as tid, max(l_discount) as score from lineitem group by l_orderkey, l_partkey)")
SWEEP = [i / 100 for i in range(11)]


def _eval(spark, sf):
    entities = load(spark, sf, "orders").select(F.col("o_orderkey").alias("eid"), F.col("o_orderpriority").alias("country"))
    items = load(spark, sf, "lineitem")
    truth = items.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("eid"), F.col("l_partkey").alias("tid"))
    scored = items.groupBy(F.col("l_orderkey").alias("eid"), F.col("l_partkey").alias("tid")).agg(F.max("l_discount").alias("score"))
    return entities, truth, scored


def _counts_sql(thresholds, score="score"):
    values = ", ".join(f"({t!r}::double)" for t in thresholds)
    return (
        f"th as (select * from (values {values}) v(threshold)), j as (select c.eid, c.tid, {score} as score, t.eid is not null as hit from cand c left join tru t on c.eid = t.eid and c.tid = t.tid), "
        "pc as (select eid, threshold, count(*) filter (score >= threshold) as p, count(*) filter (hit and score >= threshold) as tp from j cross join th group by eid, threshold), "
        "hc as (select eid, count(*) filter (hit) as h from j group by eid), tc as (select eid, count(*) as t from tru group by eid), "
        "each as (select ent.eid, country, threshold, coalesce(t, 0) as t, coalesce(h, 0) as h, coalesce(p, 0) as p, coalesce(tp, 0) as tp from ent cross join th left join pc using (eid, threshold) left join hc using (eid) left join tc using (eid)), "
        "sc as (select *, case when t = 0 and p = 0 then 1.0::double when tp > 0 then 1.25 * tp / (1.25 * tp + (p - tp) + 0.25 * (t - tp))::double else 0.0::double end as f from each)"
    )


EVALUATED = """select threshold, coalesce(country, 'all') as country, count(*) as entities, sum(tp)::bigint as tp, sum(p - tp)::bigint as fp, sum(t - tp)::bigint as fn, round(avg(f), 6) as macro_f05,
  count(*) filter (t = 0) as singletons, count(*) filter (t = 0 and p > 0) as singleton_false_positive, sum(t)::bigint as truth_pairs, sum(h)::bigint as candidate_hits,
  round(case when sum(p) = 0 then 0.0::double else sum(tp)::double / sum(p) end, 6) as precision, round(case when sum(t) = 0 then 0.0::double else sum(tp)::double / sum(t) end, 6) as recall,
  round(sum(h)::double / nullif(sum(t), 0), 6) as blocking_recall from sc group by grouping sets ((threshold), (threshold, country))"""


@query("matcher_eval_all_country", "with " + ", ".join(EVAL) + ", " + _counts_sql([0.05]) + EVALUATED)
def matcher_eval_all_country(spark, sf):
    return metrics.matcher_evaluation(metrics.matcher_counts(*_eval(spark, sf), [0.05]))


@query("threshold_sweep", "with " + ", ".join(EVAL) + ", " + _counts_sql(SWEEP) + EVALUATED)
def threshold_sweep(spark, sf):
    return metrics.matcher_evaluation(metrics.matcher_counts(*_eval(spark, sf), SWEEP))


@query("best_threshold", "with " + ", ".join(EVAL) + ", " + _counts_sql(SWEEP) + f", e as ({EVALUATED}) select * from e where country = 'all' order by macro_f05 desc, threshold desc limit 1")
def best_threshold(spark, sf):
    return metrics.best_threshold(threshold_sweep(spark, sf))


@query("baseline_sweep", "with " + ", ".join(EVAL) + ", " + _counts_sql(metrics.heuristic_thresholds(), "1 + 34 * score") + EVALUATED)
def baseline_sweep(spark, sf):
    entities, truth, scored = _eval(spark, sf)
    return metrics.matcher_evaluation(metrics.matcher_counts(entities, truth, scored.withColumn("score", 1 + 34 * F.col("score")), metrics.heuristic_thresholds()))


@query("model_threshold_sweep", "with " + ", ".join(EVAL) + ", " + _counts_sql(metrics.model_thresholds(), "10 * score") + EVALUATED)
def model_threshold_sweep(spark, sf):
    entities, truth, scored = _eval(spark, sf)
    return metrics.matcher_evaluation(metrics.matcher_counts(entities, truth, scored.withColumn("score", 10 * F.col("score")), metrics.model_thresholds()))


@query("match_histogram", "with " + ", ".join(EVAL) + " select coalesce(n, 0) as matches, count(*) as entities from ent left join (select eid, count(*) as n from tru group by eid) using (eid) group by 1")
def match_histogram(spark, sf):
    entities, truth, _ = _eval(spark, sf)
    return metrics.match_histogram(entities, truth)


LIMITS = (10, 25, 50, 100)


@query("blocking_recall_at_k", sql.chain(*POOLED, sql.PAIRS, sql.TRUTH) + f""", rk as (select eid, tid, row_number() over (partition by eid order by {sql.CHEAP} desc, tid desc) as rank from pairs),
ks as (select * from (values (10), (25), (50), (100)) v(k)), ent as (select entity_id as eid, country from prep where source = 1), ss as (select country, count(*) as targets from prep where source <> 1 group by country),
tc as (select eid, count(distinct tid) as t from truth group by eid),
cc as (select eid, k, count(*) as c, count(tr.tid) as r from rk join ks on rank <= k left join (select distinct * from truth) tr using (eid, tid) group by eid, k),
each as (select ent.eid, country, k, coalesce(t, 0) as t, coalesce(c, 0) as c, coalesce(r, 0) as r, coalesce(targets, 0) as targets from ent cross join ks left join tc using (eid) left join cc using (eid, k) left join ss using (country)),
p95 as (select k, list_sort(list(c))[least(count(*) - 1, cast(floor(0.95 * count(*)) as bigint)) + 1] as p from each group by k)
select k, coalesce(country, 'all') as country, count(*) as entities, count(*) filter (t > 0) as positive_entities, sum(t)::bigint as truth_pairs, sum(r)::bigint as recovered_pairs, count(*) filter (t > 0 and t = r) as all_matches_recovered,
  sum(c)::bigint as candidate_total, count(*) filter (c = 0) as no_candidate_entities, count(*) filter (t = 0) as singleton_entities, count(*) filter (t = 0 and c > 0) as singleton_with_candidates,
  round(sum(r)::double / nullif(sum(t), 0), 6) as pair_recall, round(sum(case when t > 0 then r::double / t end) / nullif(count(*) filter (t > 0), 0), 6) as mean_entity_recall, round(sum(c)::double / count(*), 6) as average_candidates,
  round((count(*) filter (t > 0 and t = r))::double / nullif(count(*) filter (t > 0), 0), 6) as all_recovered_fraction,
  case when country is null then any_value(p) end as p95_candidates, case when country is null then max(c) end as max_candidates, case when country is null then round(1 - sum(c)::double / nullif(sum(targets), 0), 6) end as reduction_ratio
from each join p95 using (k) group by grouping sets ((k), (k, country))""")
def blocking_recall_at_k(spark, sf):
    raw = biz_docs(spark, sf)
    refs, targets = sides(raw)
    scored = blocking.attach(blocking.pool(blocking.postings(refs, "eid"), blocking.postings(targets, "tid")), refs, targets).withColumn("cheap", sim.cheap_score("a", "b"))
    ranked = blocking.top(scored, "cheap", max(LIMITS), ties_descending=True)
    sizes = targets.groupBy("country").agg(F.count(F.lit(1)).alias("targets"))
    return metrics.blocking_recall(refs.select("eid", "country"), silver(raw), ranked, LIMITS, sizes)


@query("stage_recall", sql.chain(*POOLED, sql.PAIRS, sql.TRUTH) + f""", tr as (select distinct * from truth), pre as (select eid, tid from pairs qualify row_number() over (partition by eid order by {sql.CHEAP} desc, tid desc) <= 500),
cut as (select eid, tid from pairs qualify row_number() over (partition by eid order by {sql.CHEAP} desc, tid desc) <= 100),
c as (select 0 as step, 'pool' as stage, eid, tid from pool union all select 1, 'prefilter', eid, tid from pre union all select 2, 'top_100', eid, tid from cut),
n as (select step, stage, eid, count(*) as n, count(tr.tid) as hits from c left join tr using (eid, tid) group by step, stage, eid)
select *, coalesce(recovered <= lag(recovered) over (order by step), true) as monotone from (
select step, stage, sum(n)::bigint as pairs, sum(hits)::bigint as recovered, max(n) as max_pairs, (select count(*) from tr) as truth_pairs, round(sum(hits)::double / nullif((select count(*) from tr), 0), 6) as recall from n group by step, stage)""")
def stage_recall(spark, sf):
    pairs = _attached(spark, sf).withColumn("cheap", sim.cheap_score("a", "b")).select("eid", "tid", "cheap")
    cuts = {name: blocking.top(pairs, "cheap", k, ties_descending=True) for name, k in (("prefilter", blocking.PREFILTER), ("top_100", blocking.CANDIDATES))}
    return metrics.stage_recall(silver(biz_docs(spark, sf)), {"pool": pairs, **cuts})


BOOT = f"""with {", ".join(EVAL)}, {_counts_sql([0.03, 0.07])},
smp as (select o_orderkey as eid, sha256('boot-sample:' || o_orderkey) as hs from orders order by hs, eid limit 1000),
d as (select eid, hs, sum(case when threshold = 0.03 then f else -f end) as delta from sc join smp using (eid) group by eid, hs),
pl as (select delta, row_number() over (order by hs) - 1 as pos from d), n as (select count(*) as n from pl),
dr as (select i // n as rep, i % n as draw, n from n, range(5000 * (select n from n)) r(i)),
m as (select rep, avg(delta) as m from dr join pl on pos = concat('0x', substr(sha256('boot:' || rep || ':' || draw), 1, 8))::bigint % n group by rep)
select round(quantile_cont(m, 0.025), 6) as low, round(quantile_cont(m, 0.975), 6) as high, count(*) as replicates, (select round(avg(delta), 6) from d) as mean_delta from m"""


@query("bootstrap_ci", BOOT)
def bootstrap_ci(spark, sf):
    counts = metrics.matcher_counts(*_eval(spark, sf), [0.03, 0.07])
    f = metrics.entity_score(F.col("t"), F.col("p"), F.col("tp"))
    sample = sampling.bottom_k(load(spark, sf, "orders").select(F.col("o_orderkey").alias("eid")), "eid", "boot-sample", 1000)
    deltas = counts.drop("h").join(F.broadcast(sample), "eid").groupBy("eid", "h").agg(F.sum(F.when(F.col("threshold") == 0.03, f).otherwise(-f)).alias("delta"))
    out = sampling.bootstrap(deltas, "delta", "h", 5000)
    return out.select(F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "replicates", F.round("mean_delta", 6).alias("mean_delta"))


@query("timing_stats", "select count(*) as queries, round(1000 * avg(value), 6) as mean_ms, round(1000 * quantile_cont(value, 0.95), 6) as p95_ms, round(1 / avg(value), 6) as queries_per_s, round(avg(value) * 1000 / 3600, 6) as projected_hours from events")
def timing_stats(spark, sf):
    out = metrics.timing(load(spark, sf, "events"), "value", 1000)
    return out.select("queries", *(F.round(c, 6).alias(c) for c in ("mean_ms", "p95_ms", "queries_per_s", "projected_hours")))


# ---- integrity and outputs


@query("integrity_orphans", "select l_orderkey, l_linenumber from lineitem where l_orderkey not in (select o_orderkey from orders where o_orderstatus <> 'P')")
def integrity_orphans(spark, sf):
    kept = load(spark, sf, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return integrity.orphans(load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber"), kept, "l_orderkey")


@query("integrity_duplicates", "select l_orderkey, l_partkey, count(*) as n from lineitem group by 1, 2 having count(*) > 1")
def integrity_duplicates(spark, sf):
    return integrity.duplicates(load(spark, sf, "lineitem"), ["l_orderkey", "l_partkey"])


@query("integrity_shared_owner", "select l_partkey, count(distinct l_orderkey) as owners from lineitem where l_returnflag = 'R' group by 1 having count(distinct l_orderkey) > 1")
def integrity_shared_owner(spark, sf):
    return integrity.shared_owners(load(spark, sf, "lineitem").where("l_returnflag = 'R'"), "l_partkey", "l_orderkey")


@query("integrity_conflicts", "select l_orderkey, l_partkey from (select l_orderkey, l_partkey, first_value(l_orderkey) over (partition by l_partkey order by l_orderkey) as o from lineitem where l_returnflag = 'R') where o <> l_orderkey")
def integrity_conflicts(spark, sf):
    return integrity.conflicting_links(load(spark, sf, "lineitem").where("l_returnflag = 'R'"), "l_partkey", "l_orderkey", "l_orderkey").select("l_orderkey", "l_partkey")


@query("country_disagreement", "select l_orderkey, l_suppkey from lineitem left join (select o_orderkey, c_nationkey from orders join customer on o_custkey = c_custkey) on l_orderkey = o_orderkey join supplier on l_suppkey = s_suppkey where c_nationkey is distinct from s_nationkey")
def country_disagreement(spark, sf):
    owner = load(spark, sf, "orders").join(load(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("l_orderkey"), F.col("c_nationkey").alias("country"))
    supplier = load(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("country"))
    return integrity.disagreements(load(spark, sf, "lineitem").select("l_orderkey", "l_suppkey"), owner, supplier, "l_orderkey", "l_suppkey").select("l_orderkey", "l_suppkey")


@query("integrity_report", """with c as (select 0 as step, 'orphans' as "check", count(*) as failures from lineitem anti join (select o_orderkey as l_orderkey from orders) using (l_orderkey)
union all select 1, 'shared', count(*) from (select l_partkey from lineitem where l_returnflag = 'R' group by 1 having count(distinct l_orderkey) > 1)
union all select 2, 'duplicates', count(*) from (select 1 from lineitem group by l_orderkey, l_partkey having count(*) > 1)
union all select 3, 'conflicts', count(*) from (select l_orderkey, first_value(l_orderkey) over (partition by l_partkey order by l_orderkey) as o from lineitem where l_returnflag = 'R') where o <> l_orderkey
union all select 4, 'countries', count(*) from lineitem left join (select o_orderkey, c_nationkey from orders join customer on o_custkey = c_custkey) on l_orderkey = o_orderkey join supplier on l_suppkey = s_suppkey where c_nationkey is distinct from s_nationkey)
select *, case when failures = 0 then 'PASS' else 'FAIL' end as status from c""")
def integrity_report(spark, sf):
    items = load(spark, sf, "lineitem")
    orders = load(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"))
    checks = {"shared": integrity_shared_owner, "duplicates": integrity_duplicates, "conflicts": integrity_conflicts, "countries": country_disagreement}
    return integrity.report({"orphans": integrity.orphans(items, orders, "l_orderkey"), **{n: f(spark, sf) for n, f in checks.items()}})


LISTS = sql.chain(*POOLED, sql.PAIRS) + f", r as (select eid, tid, {sql.CHEAP} as s, row_number() over (partition by eid order by {sql.CHEAP} desc, tid desc) as rank from pairs qualify rank <= 100), " + """
l as (select eid, string_agg(tid, ',' order by rank) as c, string_agg(tid, ',' order by rank) filter (s >= 2.5) as m from r group by eid)"""


def _lists(spark, sf):
    scored = _attached(spark, sf).withColumn("cheap", sim.cheap_score("a", "b"))
    ranked = blocking.top(scored, "cheap", blocking.CANDIDATES, ties_descending=True).select("eid", "tid", "rank", "cheap")
    refs, _ = sides(biz_docs(spark, sf))
    listed = records.id_lists(refs.select("eid", "country"), ranked).withColumnRenamed("ids", "candidate_ids")
    matched = records.id_lists(refs.select("eid"), ranked.where(F.col("cheap") >= 2.5)).withColumnRenamed("ids", "matched_ids")
    return listed.join(matched, "eid")


@query("output_lists_ordered", LISTS + " select entity_id as eid, country, coalesce(c, '') as candidate_ids, coalesce(m, '') as matched_ids from prep left join l on eid = entity_id where source = 1")
def output_lists_ordered(spark, sf):
    return _lists(spark, sf)


@query("output_summary", LISTS + """, o as (select country, coalesce(c, '') as c, coalesce(m, '') as m from prep left join l on eid = entity_id where source = 1)
select coalesce(country, 'all') as country, count(*) as n_rows, sum(len(list_filter(string_split(c, ','), lambda x: x <> '')))::bigint as candidate_pairs, sum(len(list_filter(string_split(m, ','), lambda x: x <> '')))::bigint as matched_pairs,
  count(*) filter (c = '') as empty_candidates, count(*) filter (m = '') as empty_matches from o group by grouping sets ((), (country))""")
def output_summary(spark, sf):
    return metrics.output_summary(_lists(spark, sf), "candidate_ids", "matched_ids")


#: Lists of which every eighth breaks one rule: what customer k's candidates, matches and places are, by k % 8.
PLANTED = """pl as (select 'S1-' || k as eid, k as s_pos, case when k % 8 = 3 then k + 1 else k end as c_pos, case when k % 8 = 6 then null else k end as m_pos,
  case k % 8 when 0 then ['S2-' || k, 'S2-' || k] when 1 then ['S1-' || k, 'S2-' || k] when 4 then list_transform(range(0, 101), lambda i: 'S3-' || i) else ['S2-' || k, 'S3-' || k] end as c,
  case when k % 8 = 6 then null when k % 8 = 1 then ['S1-' || k] when k % 8 = 2 then ['S3-x' || k] when k % 8 = 4 then ['S3-5'] when k % 8 = 7 then [] else ['S2-' || k] end as m
  from (select c_custkey as k from customer))"""


@query("output_validation", f"""with {PLANTED} select eid, s_pos is distinct from c_pos or s_pos is distinct from m_pos as misaligned,
  len(list_distinct(c)) < len(c) or coalesce(len(list_distinct(m)) < len(m), false) as repeated, len(c) > 100 as too_many,
  len(list_filter(list_concat(c, coalesce(m, [])), lambda x: not (starts_with(x, 'S2-') or starts_with(x, 'S3-')))) > 0 as wrong_source,
  coalesce(len(list_filter(m, lambda x: not list_contains(c, x))) > 0, false) as beyond_candidates from pl""")
def output_validation(spark, sf):
    k = F.col("k")
    s = lambda n, c: F.concat(F.lit(f"S{n}-"), c.cast("string"))
    rows = load(spark, sf, "customer").select(F.col("c_custkey").alias("k"), s(1, F.col("c_custkey")).alias("eid"))
    kind = k % 8
    many = F.transform(F.sequence(F.lit(0), F.lit(100)), lambda i: s(3, i))
    c_ids = F.when(kind == 0, F.array(s(2, k), s(2, k))).when(kind == 1, F.array(s(1, k), s(2, k))).when(kind == 4, many).otherwise(F.array(s(2, k), s(3, k)))
    m_ids = F.when(kind == 1, F.array(s(1, k))).when(kind == 2, F.array(s(3, F.concat(F.lit("x"), k.cast("string"))))).when(kind == 4, F.array(F.lit("S3-5"))).when(kind == 7, F.array().cast("array<string>")).otherwise(F.array(s(2, k)))
    source = rows.select("eid", k.alias("pos"))
    candidates = rows.select("eid", F.when(kind == 3, k + 1).otherwise(k).alias("pos"), c_ids.alias("ids"))
    matches = rows.where(kind != 6).select("eid", k.alias("pos"), m_ids.alias("ids"))
    return integrity.output_checks(source, candidates, matches)


@query("recompute_saved", sql.chain(*POOLED, sql.PAIRS, sql.TRUTH) + LISTS[len(sql.chain(*POOLED, sql.PAIRS)):] + """, o as (select coalesce(c, '') as c, coalesce(m, '') as m, entity_id from prep left join l on eid = entity_id where source = 1), tr as (select distinct * from truth)
select count(*) as entities, sum(len(list_filter(string_split(m, ','), lambda x: x <> '')))::bigint as predicted,
  (select count(*) from (select entity_id as eid, unnest(string_split(m, ',')) as tid from o) join tr using (eid, tid)) as tp, (select count(*) from tr) as truth_pairs,
  (select count(*) from (select entity_id as eid, unnest(string_split(c, ',')) as tid from o) join tr using (eid, tid)) as candidate_hits from o""")
def recompute_saved(spark, sf):
    """Figures from the files alone: the lists are written as users get them, and read back."""
    saved = f"{scratch.folder(spark)}/lists-{uuid.uuid4().hex}"
    found = _lists(spark, sf)
    for column, name in (("candidate_ids", "candidate_entity_ids"), ("matched_ids", "matched_entity_ids")):
        records.write_lists(found.select("eid", F.col(column).alias("ids")), f"{saved}/{name}", name)
    candidates, matches = (records.read_lists(spark, f"{saved}/{n}") for n in ("candidate_entity_ids", "matched_entity_ids"))
    return metrics.recomputed(candidates, matches, silver(biz_docs(spark, sf)))




# ---- models

TREE_COLUMNS = ("l_quantity", "l_discount", "l_extendedprice")


def fixed_trees() -> models.Trees:
    return models.Trees(
        roots=np.array([0, 3]), feature=np.array([0, 0, 0, 2, 1, 0, 0, 0]), threshold=np.array([24.0, 0, 0, 30000.0, 0.05, 0, 0, 0]),
        left=np.array([1, -1, -1, 4, 5, -1, -1, -1]), right=np.array([2, -1, -1, 7, 6, -1, -1, -1]), missing_left=np.ones(8, bool),
        value=np.array([0, 0.5, -0.25, 0, 0, 0.125, -0.5, 1.0]), baseline=0.1,
    )


@query("tree_score", """select l_orderkey, l_linenumber, round(1 / (1 + exp(-(0.1 + case when l_quantity <= 24 then 0.5 else -0.25 end + case when l_extendedprice <= 30000 then case when l_discount <= 0.05 then 0.125 else -0.5 end else 1.0 end)))::double, 6) as score from lineitem""")
def tree_score(spark, sf):
    score = models.as_expression(fixed_trees(), TREE_COLUMNS)
    return load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.round(score, 6).alias("score"))


@query("tree_score_batches", ORACLES["tree_score"])
def tree_score_batches(spark, sf):
    scored = models.score_trees(load(spark, sf, "lineitem"), fixed_trees(), TREE_COLUMNS)
    return scored.select("l_orderkey", "l_linenumber", F.round("score", 6).alias("score"))


def _labelled(spark, sf):
    raw = biz_docs(spark, sf)
    refs, targets = sides(raw)
    pairs = linkage.label(linkage.candidate_features(refs, targets), silver(raw))
    return refs, silver(raw), models.assemble(pairs).persist()


@query("gbt_train_predict")
def gbt_train_predict(spark, sf):
    _, _, pairs = _labelled(spark, sf)
    model = models.train(pairs, models.Config(5, 3, 10))
    return models.predict(model, pairs).select("eid", "tid", "rank", "label", F.round("score", 6).alias("score"))


@query("model_select")
def model_select(spark, sf):
    refs, truth, pairs = _labelled(spark, sf)
    tuned = sampling.holdout(pairs, "eid", "matcher:2026")
    entities = sampling.holdout(refs.select("eid", "country"), "eid", "matcher:2026").where("held_out")
    grid = (models.Config(3, 3, 10), models.Config(5, 3, 10))
    tune_truth = truth.join(entities.select("eid"), "eid", "left_semi")
    model, config, threshold = models.select(tuned.where("not held_out"), tuned.where("held_out"), entities, tune_truth, grid, floor=0.0)
    scored = models.predict(model, tuned.where("held_out")).select("eid", "tid", "rank", "score")
    return models.decide(scored, threshold).select("eid", "tid", "rank", F.round("score", 6).alias("score"), F.lit(threshold).alias("threshold"), F.lit(config.iterations).alias("iterations"))


def pair_trees() -> models.Trees:
    """Two small trees over the pair features, as plain arrays."""
    name, address, length = (FEATURES.index(n) for n in ("name_token_jaccard", "address_token_jaccard", "name_length_ratio"))
    return models.Trees(
        roots=np.array([0, 5]), feature=np.array([name, address, 0, 0, 0, length, 0, 0]), threshold=np.array([0.4, 0.3, 0, 0, 0, 0.75, 0, 0]),
        left=np.array([1, 2, -1, -1, -1, 6, -1, -1]), right=np.array([4, 3, -1, -1, -1, 7, -1, -1]), missing_left=np.zeros(8, bool),
        value=np.array([0, 0, -1.5, 0.25, 1.0, 0, -0.5, 0.5]), baseline=0.1,
    )


MARGIN = f"(0.1 + case when {sql.jaccard('ant', 'bnt')} <= 0.4 then case when {sql.jaccard('aat', 'bat')} <= 0.3 then -1.5 else 0.25 end else 1.0 end + case when (case when greatest(length(ac), length(bc)) = 0 then 0 else least(length(ac), length(bc))::double / greatest(length(ac), length(bc)) end) <= 0.75 then -0.5 else 0.5 end)"


@query("match_trees", sql.chain(*POOLED, sql.PAIRS) + f""", r as (select eid, tid, 1 / (1 + exp(-{MARGIN}::double)) as p, row_number() over (partition by eid order by {sql.CHEAP} desc, tid desc) as rank from pairs qualify rank <= 100),
l as (select eid, string_agg(tid, ',' order by rank) as c, string_agg(tid, ',' order by rank) filter (p >= 0.6) as m from r group by eid)
select entity_id as eid, coalesce(c, '') as candidate_entity_ids, coalesce(m, '') as matched_entity_ids from prep left join l on eid = entity_id where source = 1""")
def match_trees(spark, sf):
    """Inference from records to lists: candidates, features, exported trees, decisions."""
    refs, targets = sides(biz_docs(spark, sf))
    pairs = blocking.attach(blocking.pool(blocking.postings(refs, "eid"), blocking.postings(targets, "tid")), refs, targets)
    ranked = blocking.top(pairs.withColumn("cheap", sim.cheap_score("a", "b")), "cheap", blocking.CANDIDATES, ties_descending=True)
    return linkage.match(refs, targets, linkage.by_trees(pair_trees()), 0.6, ranked)


@query("index_probe", sql.chain(*POOLED) + " select eid, tid from pool")
def index_probe(spark, sf):
    """The pool from an index that was built and opened again."""
    refs, targets = sides(biz_docs(spark, sf))
    path = f"{scratch.folder(spark)}/index-{uuid.uuid4().hex}"
    linkage.build_index(targets, path)
    return linkage.probe(refs, spark, path)


@query("head_limit", "select o_orderkey, o_orderdate from orders order by o_orderkey limit 50")
def head_limit(spark, sf):
    return sampling.head(load(spark, sf, "orders").select("o_orderkey", "o_orderdate"), "o_orderkey", 50)


@query("integrity_issues", """with i as (select 'shared' as "check", l_partkey as n from lineitem where l_returnflag = 'R' group by l_partkey having count(distinct l_orderkey) > 1
  union all select 'orphans', l_orderkey from lineitem anti join (select o_orderkey as l_orderkey from orders where o_orderstatus <> 'P') using (l_orderkey))
select "check", '{"n":' || n || '}' as issue from i qualify row_number() over (partition by "check" order by issue) <= 20""")
def integrity_issues(spark, sf):
    """The first 20 rows of each check that fails."""
    items = load(spark, sf, "lineitem")
    kept = load(spark, sf, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    shared = integrity.shared_owners(items.where("l_returnflag = 'R'"), "l_partkey", "l_orderkey").select(F.col("l_partkey").alias("n"))
    return integrity.issues({"shared": shared, "orphans": integrity.orphans(items.select("l_orderkey"), kept, "l_orderkey").select(F.col("l_orderkey").alias("n"))})


@query("integrity_tallies", """select 0 as step, 'orders' as name, count(*) as n_rows, count(distinct o_orderkey) as n_keys from orders union all select 1, 'items', count(*), count(distinct l_orderkey) from lineitem
  union all select 2, 'customers', count(*), count(distinct c_custkey) from customer""")
def integrity_tallies(spark, sf):
    return integrity.tallies({"orders": (load(spark, sf, "orders"), "o_orderkey"), "items": (load(spark, sf, "lineitem"), "l_orderkey"), "customers": (load(spark, sf, "customer"), "c_custkey")})


@query("match_lists")
def match_lists(spark, sf):
    refs, targets = sides(biz_docs(spark, sf))
    return linkage.match_exact(refs, targets)
