"""The corpus pipeline: quality rules, exact dedup, near-duplicate dedup, secret redaction, packing.

``STAGES`` lists (name, function) in order. A function takes (spark, docs, sf_dir), where ``docs`` has the columns of
``documents`` and holds what the stage before it kept, and returns a DataFrame; all but the last return those columns.
Null texts have no words and are rejected by the first stage; extra columns of ``docs`` pass through all stages but the
last; rows without an id pass where an id would be needed; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from logweft.llm import common, exact_dedup, jaccard_join, packing, quality_rules, secret_scan


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the repetition limits keep."""
    return quality_rules.keep_good(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, the one with the largest id, in two batches through a new digest index."""
    return exact_dedup.keep_new(docs, batches=2)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each component of documents whose shingle sets are linked, directly or not."""
    found = jaccard_join.near_duplicates(docs)
    gone = common.written(found.filter("doc_id <> component_id").select("doc_id"), "near-duplicates")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its secrets masked; ``n_chars`` follows the text."""
    masked = secret_scan.redact(docs)
    if "n_chars" in masked.columns:
        masked = masked.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars"))
                                   .otherwise(F.length("text").cast("long")))
    return masked.select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document with its place in a packed sequence."""
    return packing.pack_documents(docs)


STAGES = [("quality_rules", quality), ("exact_dedup", exact), ("jaccard_join", near), ("secret_scan", secrets),
          ("best_fit_packing", packed)]

#: The first stage reads suffix arrays, which SQL cannot express; tests run the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and reread as the next one's input."""
    common.prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
