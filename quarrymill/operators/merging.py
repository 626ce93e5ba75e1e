"""Merge of stores built apart: the target's rows win."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrymill.store import Store, Tables

TEXT = ["document_id", "extractor"]


def add_missing(target: DataFrame, source: DataFrame, key: list[str]) -> DataFrame:
    """Target rows, and source rows whose key the target lacks."""
    new = source.join(target.select(*key).distinct(), key, "left_anti").dropDuplicates(key)
    return target.unionByName(new.select(*target.columns))


def merge_chunks(target: DataFrame, source: DataFrame) -> DataFrame:
    """A source chunk is new if neither its place nor its content is in the target's text."""
    new = source.join(target.select(*TEXT, "chunk_index"), [*TEXT, "chunk_index"], "left_anti")
    new = new.join(target.select(*TEXT, "content_hash").distinct(), [*TEXT, "content_hash"], "left_anti")
    return target.unionByName(new.select(*target.columns))


def merge_keywords(target: DataFrame, source: DataFrame) -> DataFrame:
    """Links of a model are taken only where the target's text has none of it; ranks are dealt anew in order."""
    key = [*TEXT, "model_name"]
    new = source.join(target.select(*key).distinct(), key, "left_anti").dropDuplicates([*key, "value"])
    new = new.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy("rank", "value")))
    return target.unionByName(new.select(*target.columns))


def merge_tables(target: Tables, source: Tables) -> Tables:
    """All tables merged by natural key; embeddings are left to be built again."""
    offset = F.broadcast(target["paths"].agg(F.coalesce(F.max("path_seq") + 1, F.lit(0)).alias("_o")))
    paths = source["paths"].crossJoin(offset).withColumn("path_seq", F.col("path_seq") + F.col("_o")).drop("_o")
    return target | {
        "documents": add_missing(target["documents"], source["documents"], ["document_id"]),
        "paths": add_missing(target["paths"], paths, ["path"]),
        "texts": add_missing(target["texts"], source["texts"], TEXT),
        "chunks": merge_chunks(target["chunks"], source["chunks"]),
        "keywords": merge_keywords(target["keywords"], source["keywords"]),
        # by the natural key: summaries without a work key are told apart as well
        "summaries": add_missing(target["summaries"], source["summaries"], [*TEXT, "model_name", "prompt_version"]),
    }


def content_conflicts(target: DataFrame, source: DataFrame) -> DataFrame:
    """Texts of one document that differ between the stores; the target's stays."""
    other = source.select(*TEXT, F.col("content_hash").alias("source_hash"))
    return target.join(other, TEXT).where(F.col("content_hash") != F.col("source_hash")).select(*TEXT, "content_hash", "source_hash")


def merge_stores(target: Store, sources: list[Store]) -> int:
    """Merge sources in order; the number of their documents. The target itself is skipped, a missing store is an error."""
    seen = 0
    for store in sources:
        if store.resolved() == target.resolved():
            continue
        if not store.exists():
            raise FileNotFoundError(store.path)
        theirs = store.tables()
        seen += theirs["documents"].count()
        target.commit(merge_tables(target.tables(), theirs))
    return seen
