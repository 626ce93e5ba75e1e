"""A corpus pipeline: quality, repeated lines, near duplicates, benchmark leaks, mixing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.llm.bradley_terry import keep_good
from quarrymill.llm.cluster import written
from quarrymill.llm.decontamination import decontaminate
from quarrymill.llm.line_dedup import EVERY_LINE, line_dedup
from quarrymill.llm.ngram_join import one_of_each
from quarrymill.llm.raking import sample_to_targets

#: Share of the tokens that the mix keeps.
KEEP_SHARE = 0.7
#: No SQL: the classifier is learned, and components are iterative. Stages are tested against brute force.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality score of 0.3 or more."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier line matches; n_chars follows the text."""
    out = line_dedup(docs, min_chars=EVERY_LINE)
    if "n_chars" in out.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates, once if its row is repeated; documents without words stay."""
    return one_of_each(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, re-parameterised or not."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample with even shares of tokens by source, language and topic, as far as the documents allow."""
    return sample_to_targets(docs, keep_share=KEEP_SHARE)


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("benchmark_leaks", benchmark_leaks), ("mixing", mixing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each on the table that the one before it wrote; the last is returned."""
    docs, drop = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        docs, drop_next = written(stage(spark, docs, sf_dir))
        if drop:
            drop()
        drop = drop_next
    return STAGES[-1][1](spark, docs, sf_dir)
