"""Raw documents to packed sequences: each stage reads what the one before kept.

1. quality    line-frequency rules: rejected documents go, common lines go from the others
2. near_dups  n-gram Jaccard join, five words and 80 %: one document of each group stays
3. leaks      documents that leak a benchmark item go
4. pii        personal data is replaced by its kind
5. packing    the texts' tokens in sequences of at most 4,096

All but the last return the columns of documents; the last returns a row for each piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from linkspan.llm import decontamination, ngram_join, packing, pii, quality
from linkspan.llm.common import materialise, scratch_paths, sweep, table
from linkspan.ship import ship


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_of_each(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality", quality_rules),
    ("near_dups", near_duplicates),
    ("leaks", benchmark_leaks),
    ("pii", personal_data),
    ("packing", packed),
]

#: Shingle verification, bootstrapping and BM25 packing are beyond SQL. tests/llm/test_pipeline.py holds run() against a plain Python
#: version of the stages; of the leaks alone it takes the operator's word, which tests of its own hold to planted questions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written and read again before the next, and what it wrote on its way goes."""
    ship(spark)
    others = scratch_paths()
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialise(docs)
            sweep(spark, others | {docs._scratch})
    return docs
