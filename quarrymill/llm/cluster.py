"""Helpers that keep plans safe on a cluster: durable cuts, checked broadcasts, skew-safe joins."""

from __future__ import annotations

import gc
import math
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows a checked broadcast may hold; at under 100 bytes a row this stays below 50 MB.
BROADCAST_ROWS = 400_000
#: A group holding more than this share of all rows is hot; there are at most 1/share of them.
HOT_SHARE = 1e-5


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names; only a local session without one gets its own."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named and not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="quarrymill-"))


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and go on from the files, so that lost executors cost no recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    out = df.checkpoint(eager=True)
    # a checkpoint keeps the names that Spark gives the columns of ``df``, and a join of the two could not tell them apart
    return out.select(*[F.col(f"`{c}`").alias(c) for c in out.columns])


def written(df: DataFrame) -> tuple[DataFrame, Callable[[], None]]:
    """``df`` as a compressed table in the checkpoint folder, for large rows that are read several times; and a way to drop it."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)

    def drop() -> None:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)

    return spark.read.parquet(path), drop


def free_shuffles(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files that nothing refers to now; else they stay until the driver happens to collect its garbage."""
    gc.collect()
    spark._jvm.System.gc()


def width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def semi_by_key(left: DataFrame, keys: DataFrame, key: str, n_keys: int | None = None, how: str = "left_semi") -> DataFrame:
    """Join on ``key``; ``keys`` has one row for each key. Broadcast when its counted rows allow it, shuffled otherwise."""
    n = keys.count() if n_keys is None else n_keys
    return left.join(F.broadcast(keys) if n <= BROADCAST_ROWS else keys.hint("merge"), key, how)


def join_groups(left: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Left join of rows with a table of their groups (one row a key; ``size``: its rows in ``left``).

    Groups with over ``HOT_SHARE`` of all rows are at most ``1 / HOT_SHARE`` and are broadcast;
    the rest shuffle, and no key among them is large enough to hold up a task.
    """
    extra = [c for c in groups.columns if c != key]
    if total <= 1 / HOT_SHARE:  # so there are no more groups than that either
        return left.join(F.broadcast(groups), key, "left")
    edge = math.ceil(total * HOT_SHARE)
    hot = groups.where(F.col(size) >= edge).select(key, F.struct(*extra).alias("_hot"))
    marked = left.join(F.broadcast(hot), key, "left")
    # a row that is answered already takes a random key that meets nothing, so hot keys are not dealt to one task
    cold = groups.where(F.col(size) < edge).select(F.col(key).cast("string").alias("_k"), F.struct(*extra).alias("_cold"))
    own = F.when(F.col("_hot").isNull(), F.col(key).cast("string")).otherwise(F.concat(F.lit("\x00"), F.xxhash64(*[F.col(c) for c in left.columns if not c.startswith("_")]).cast("string")))
    out = marked.withColumn("_k", own).join(cold.hint("merge"), "_k", "left")
    pick = F.coalesce(F.col("_hot"), F.col("_cold"))
    return out.select(*left.columns, *[pick[c].alias(c) for c in extra])


def crc_mod(col: Column, n: int) -> Column:
    return F.crc32(col.cast("string").cast("binary")) % F.lit(n)


def held_out(doc_id: str, n: int, r: int) -> Column:
    """True where crc32 of the id as text leaves the remainder ``r``."""
    return F.coalesce(crc_mod(F.col(doc_id), n) == r, F.lit(False))
