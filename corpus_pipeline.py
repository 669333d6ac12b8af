"""The corpus pipeline: classify, deduplicate, decontaminate, mix and tokenize documents.

Each stage takes (spark, docs, sf_dir), where docs are the rows that the stage before it kept, and returns a DataFrame. All
but the last return the columns of documents.

Null, empty and blank texts go in the first stage, as they have no quality; very long ones go through all stages whole. Rows equal in
doc_id and text become one in the second stage; rows that share a doc_id, or have none, and differ in text are documents of their own
everywhere. Ties are settled by doc_id, then by a hash of the text. An empty table gives no rows, and columns besides doc_id, text and
source are only passed on, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from nameweave.llm import decontaminate, grammar, mixing, near_copies, quality, simhash, toxicity
from nameweave.scratch import written


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: documents that the scorer rejects go, and those that the scorer of toxic wording rejects."""
    return toxicity.without_toxic(written(quality.kept(docs), "quality_kept"))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup: of each component one document stays, that with the smallest doc_id.

    SimHash's two bits let near copies through, so those by five-word Jaccard similarity go after it.
    """
    return near_copies.without_near_copies(written(simhash.without_near_duplicates(docs), "without_near_duplicates"))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents that hold a window of any item go."""
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing to target weights: documents that the mix takes twice are there twice, those that it leaves out are gone."""
    return mixing.mixed(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token-ID output: the ids in Re-Pair grammar shards, and from them a row for each document."""
    return grammar.token_output(docs)


STAGES = [
    ("quality_classifier", classify),
    ("simhash_near_dedup", deduplicate),
    ("benchmark_decontamination", decontaminated),
    ("mixing", mix),
    ("token_output", tokenize),
]

#: Hashing with a seed, trained weights and a tokenizer are beyond SQL; tests/llm/test_pipeline.py has brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES applied to documents, each stage's rows written as Parquet to the shared folder before the next one reads them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
