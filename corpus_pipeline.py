"""A training-data pipeline: five operators one after the other, each on what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import common, decontaminate, line_dedup, minhash, packing, weak_rules


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return weak_rules.drop_low_quality(docs)


def site_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The site is the document's source; n_chars, where there is one, follows the new text."""
    out = line_dedup.drop_site_lines(docs, "source")
    own, of = common.by_position(out)
    n_chars = common.column_of(of, "n_chars")
    return own.withColumn(n_chars, F.length(common.column_of(of, "text")).cast("long")).toDF(*out.columns) if n_chars else out


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.drop_near_duplicates(docs, percent=80)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, added_tokens=True)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", site_lines),
    ("near dedup", near_duplicates),
    ("decontamination", decontaminated),
    ("packing", packed),
]

#: Expectation-maximisation and MinHash have no SQL; tests/llm/test_pipeline.py holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for at, (name, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if at + 1 < len(STAGES):
            docs = common.table(docs, name.replace(" ", "_"))
            common.drop(before)  # the stage before's table; the documents themselves are none
    return docs
