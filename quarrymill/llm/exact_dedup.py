"""Exact dedup: group by a 128-bit content hash, keep one stable id, compare bytes inside groups.

Native: DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.llm.cluster import cut, join_groups, semi_by_key

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def fold_ascii(text: Column) -> Column:
    """Lower-case A-Z only; null counts as empty. ``lower`` serves pure ASCII, where it means the same and is faster."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are equal after folding A-Z. Rows are grouped by the 128-bit MD5 of
    that; ``keep`` says whether the smallest or the largest id of a group stays. The texts of groups of
    two and more are then compared byte by byte, and a group that a collision has joined is told apart.

    Null and empty texts are one group. Rows that repeat an id count as rows; all of them carry the same
    keep_id. Rows with a null id never win over others. An empty table gives an empty result; other
    columns, whatever their names, are ignored.
    """
    best = {"min": F.min, "max": F.max}[keep]
    rows = docs.select(F.col(id_col).alias("doc_id"), fold_ascii(F.col(text_col)).alias("t"))
    light = cut(rows.select("doc_id", F.unhex(F.md5("t")).alias("h"), F.unhex(F.sha2("t", 256)).alias("sha")))
    total = light.count()
    groups = cut(light.groupBy("h").agg(best("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")))
    many = groups.where("group_size > 1")
    # bytes are compared through their least and greatest text, which each task folds before the shuffle
    ids = light.join(F.broadcast(many.select("h")), "h", "left_semi") if total <= 100_000 else semi_by_key(light, many.select("h"), "h")
    ids = ids.select("doc_id").distinct()
    texts = semi_by_key(rows, ids, "doc_id").select(F.unhex(F.md5("t")).alias("h"), "t")
    mixed = texts.groupBy("h").agg(F.min("t").alias("a"), F.max("t").alias("b")).where("a <> b").select("h")
    apart = mixed.count()
    out = join_groups(light, groups, "h", "group_size", total)
    if apart:
        own = rows.withColumn("h", F.unhex(F.md5("t"))).join(mixed, "h", "left_semi").groupBy("h", "t")
        told = own.agg(best("doc_id").alias("k2"), F.count(F.lit(1)).alias("n2")).select(F.unhex(F.sha2("t", 256)).alias("sha"), "k2", "n2")
        out = out.join(told, "sha", "left").withColumn("keep_id", F.coalesce("k2", "keep_id")).withColumn("group_size", F.coalesce("n2", "group_size"))
    return out.select(
        "doc_id",
        "keep_id",
        "group_size",
        F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep="max")


ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g USING (t)
"""
