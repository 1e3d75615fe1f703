"""Readers and writers of record files, adapters from other tables, and input fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from linkspan.functions import text

FIELDS = ("entity_id", "business_name", "business_address", "country")
SCHEMA = StructType([StructField(c, StringType()) for c in FIELDS])


def read_tsv(spark: SparkSession, path: str, schema: StructType = SCHEMA) -> DataFrame:
    """Tab-separated records with a header. A wrong header or a row of another width fails the read; empty fields are empty strings."""
    options = {"sep": "\t", "header": True, "quote": '"', "escape": '"', "mode": "FAILFAST", "enforceSchema": False}
    rows = spark.read.options(**options).schema(schema).csv(path)
    return rows.select(*(F.coalesce(c, F.lit("")).alias(c) for c in rows.columns))


def read_split(spark: SparkSession, root: str, split: str) -> DataFrame:
    """The three sources of a split, with a column that says which."""
    parts = [read_tsv(spark, f"{root}/{split}/{split}_source{n}.tsv").withColumn("source", F.lit(n)) for n in (1, 2, 3)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """eid and its matched ids, an empty array for none."""
    rows = spark.read.options(sep="\t", header=True, quote='"', escape='"').csv(path)
    first, second = rows.columns[:2]
    return rows.select(F.col(first).alias("eid"), text.list_decode(F.coalesce(second, F.lit(""))).alias("matched"))


def read_sample(spark: SparkSession, sample: str, pairs: str, split: str | None = None) -> tuple[DataFrame, DataFrame]:
    """A validation sample and its candidate lists as long pairs with ranks; of one split where it is named."""
    options = {"sep": "\t", "header": True, "quote": '"', "escape": '"'}
    rows = spark.read.options(**options).csv(sample)
    lists = spark.read.options(**options).csv(pairs)
    eid, ids = lists.columns[:2]
    ranked = lists.select(F.col(eid).alias("eid"), F.posexplode(text.list_decode(F.coalesce(ids, F.lit("")))).alias("rank", "tid"))
    rows, ranked = rows.fillna(""), ranked.withColumn("rank", F.col("rank") + 1)
    if split is not None:
        rows = rows.where(F.col("split") == split)
        ranked = ranked.join(rows.select(F.col(rows.columns[0]).alias("eid")), "eid", "left_semi")
    return rows, ranked


def write_sample(sample: DataFrame, path: str) -> None:
    """A sample of bounded size as one tab-separated file, in the order of its first column."""
    sample.orderBy(sample.columns[0]).coalesce(1).write.mode("overwrite").options(sep="\t", header=True, emptyValue="").csv(path)


def write_report(rows: DataFrame, path: str) -> None:
    """A report, a row for each line of it, as one JSON file."""
    rows.coalesce(1).write.mode("overwrite").json(path)


def read_lists(spark: SparkSession, path: str) -> DataFrame:
    """What write_lists wrote: eid and its ids as an array."""
    return read_truth(spark, path).withColumnRenamed("matched", "ids")


def id_lists(entities: DataFrame, pairs: DataFrame, order: str = "rank") -> DataFrame:
    """eid and its ids joined by commas, in rank order; entities without any keep an empty list."""
    listed = pairs.groupBy("eid").agg(F.array_sort(F.collect_list(F.struct(F.col(order), F.col("tid")))).alias("l"))
    ids = F.coalesce(text.list_encode(F.transform("l", lambda x: x["tid"])), F.lit(""))
    return entities.join(listed, "eid", "left").withColumn("ids", ids).drop("l")


def write_lists(lists: DataFrame, path: str, column: str) -> None:
    """One row for each entity, in input order: source1_entity_id, and the list under the name given."""
    rows = lists.orderBy("pos") if "pos" in lists.columns else lists.orderBy("eid")
    rows.select(F.col("eid").alias("source1_entity_id"), F.col("ids").alias(column)).write.options(sep="\t", header=True, quoteAll=False, emptyValue="").csv(path)


def fingerprint(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Name, bytes and SHA-256 of each file below a folder. Executors hash the files; each must fit in memory."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def prepare(records: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Records (entity_id, business_name, business_address, country) normalised: name, compact, nt, at and country."""
    name = text.normalize(text.strip_domain(F.coalesce("business_name", F.lit(""))))
    normal = records.select("entity_id", *keep, name.alias("name"), text.normalize(F.col("business_address")).alias("address"), text.normalize(F.col("country")).alias("country"))
    return normal.select("entity_id", *keep, "name", text.compact_name(F.col("name")).alias("compact"), text.name_tokens(F.col("name")).alias("nt"), text.address_tokens(F.col("address")).alias("at"), "country")


def prepare_v1(records: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The same by the first version's rules: no domains stripped, all marks dropped."""
    normal = records.select("entity_id", *keep, *(text.normalize(F.col(c), version=1).alias(n) for c, n in (("business_name", "name"), ("business_address", "address"), ("country", "country"))))
    return normal.select("entity_id", *keep, "name", text.compact_name(F.col("name")).alias("compact"), text.name_tokens(F.col("name")).alias("nt"), text.address_tokens(F.col("address")).alias("at"), "country")


def split_sources(prepared: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reference records (eid) and targets (tid) of prepared records with their source."""
    refs = prepared.where("source = 1").drop("source").withColumnRenamed("entity_id", "eid")
    return refs, prepared.where("source <> 1").drop("source").withColumnRenamed("entity_id", "tid")


def _entity(source: Column, key: Column) -> Column:
    return F.concat(F.lit("S"), source.cast("string"), F.lit("-"), key.cast("string"))


def from_documents(docs: DataFrame) -> DataFrame:
    """Documents as records: the first six words are the name, the next eight the address, between two numbers made of the length."""
    source = F.substring("source", 4, 9).cast("int") % 3 + 1
    word = F.split(F.ltrim(F.col("text"), F.lit(" \t\n\x0b\x0c\r")), r"[\x20\x09-\x0D]+", 15)
    line = lambda a, n: F.array_join(F.slice(word, a, n), " ")
    address = F.concat_ws(" ", (F.col("n_chars") % 997).cast("string"), line(7, 8), (F.col("n_chars") + 10000).cast("string"))
    return docs.select(_entity(source, F.col("doc_id")).alias("entity_id"), line(1, 6).alias("business_name"), address.alias("business_address"), F.col("lang").alias("country"), source.alias("source"), F.xxhash64("text").alias("text_hash"), "lang")


def from_parts(parts: DataFrame) -> DataFrame:
    """Parts as records of one country: few names, so that buckets exceed the cap."""
    source = (F.col("p_partkey") % 3 + 1).cast("int")
    return parts.select(_entity(source, F.col("p_partkey")).alias("entity_id"), F.col("p_name").alias("business_name"), F.col("p_brand").alias("business_address"), F.lit("XX").alias("country"), source.alias("source"))


def from_parties(customers: DataFrame, suppliers: DataFrame, nations: DataFrame) -> DataFrame:
    """Customers as the reference source, suppliers as the second; no addresses."""
    nation = nations.select("n_nationkey", F.col("n_name").alias("country"))
    one = customers.join(nation, customers["c_nationkey"] == nation["n_nationkey"]).select(F.concat(F.lit("S1-"), "c_custkey").alias("entity_id"), F.col("c_name").alias("business_name"), F.lit("").alias("business_address"), "country", F.lit(1).alias("source"))
    two = suppliers.join(nation, suppliers["s_nationkey"] == nation["n_nationkey"]).select(F.concat(F.lit("S2-"), "s_suppkey").alias("entity_id"), F.col("s_name").alias("business_name"), F.lit("").alias("business_address"), "country", F.lit(2).alias("source"))
    return one.unionByName(two)
