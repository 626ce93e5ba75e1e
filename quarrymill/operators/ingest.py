"""Incremental scan: what changed, what is saved, what is collected."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.functions.text import clean, content_id
from quarrymill.operators.chunking import VERSION
from quarrymill.operators.keywords import LIGHT_MODEL
from quarrymill.schema import DERIVED, EXTRACTOR
from quarrymill.sources import files as source
from quarrymill.store import Store, Tables, processing_text

KEY = ["document_id", "extractor"]
#: Paths of files to extract that are broadcast.
BROADCAST_ROWS = 200_000


def processed_texts(tables: Tables, summary_model: str) -> DataFrame:
    """Keys of texts whose derivatives are all there: a summary, chunks of this version (unless blank), the noted number of light keywords."""
    texts = processing_text(tables["texts"]).join(tables["texts"].select(*KEY, "light_keyword_count"), KEY)
    summaries = tables["summaries"].where(F.col("model_name") == summary_model).select(*KEY).distinct()
    chunks = tables["chunks"].where(F.col("chunker_version") == VERSION).select(*KEY, F.lit(True).alias("has_chunks")).distinct()
    light = tables["keywords"].where(F.col("model_name") == LIGHT_MODEL).groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_light"))
    rows = texts.join(summaries, KEY, "left_semi").join(chunks, KEY, "left").join(light, KEY, "left")
    whole = (F.col("has_chunks") | (F.trim("body") == "")) & (F.col("light_keyword_count") == F.coalesce("n_light", F.lit(0)))
    return rows.where(whole).select(*KEY)


def diff_listing(listing: DataFrame, paths: DataFrame, ready: DataFrame | None = None) -> DataFrame:
    """``listing`` (path, document_id, file_size, modified_at) with outcome: unchanged, changed or new.

    Unchanged needs equal size, time and digest, and, if ``ready`` (document_id) is given, a document in it.
    """
    old = paths.select("path", F.col("document_id").alias("_id"), F.col("file_size").alias("_size"), F.col("modified_at").alias("_at"))
    if ready is not None:
        old = old.join(ready.select(F.col("document_id").alias("_id"), F.lit(True).alias("_ready")).distinct(), "_id", "left")
    else:
        old = old.withColumn("_ready", F.lit(True))
    same = (F.col("_size") == F.col("file_size")) & (F.col("_at") == F.col("modified_at")) & (F.col("_id") == F.col("document_id")) & F.coalesce("_ready", F.lit(False))
    out = listing.join(old, "path", "left")
    return out.withColumn("outcome", F.when(F.col("_id").isNull(), "new").when(F.coalesce(same, F.lit(False)), "unchanged").otherwise("changed")).drop("_id", "_size", "_at", "_ready")


def under(path, root: str):
    """Strictly below a root: siblings that share its beginning do not count."""
    return F.startswith(path, F.lit(root.rstrip("/") + "/"))


def missing_paths(paths: DataFrame, listing: DataFrame, root: str) -> DataFrame:
    """Stored paths under the root that the listing lacks."""
    return paths.where(under(F.col("path"), root)).join(listing.select("path"), "path", "left_anti")


def orphans(documents: DataFrame, paths: DataFrame) -> DataFrame:
    """Documents without a path."""
    return documents.join(paths.select("document_id"), "document_id", "left_anti")


def cascade(tables: Tables, survivors: DataFrame) -> Tables:
    """Texts and derivatives of ``survivors`` (document_id) only."""
    keep = survivors.select("document_id").distinct()
    return {name: tables[name].join(keep, "document_id", "left_semi") for name in ("texts", *DERIVED)}


def drop_derivatives(tables: Tables, keys: DataFrame) -> Tables:
    """Derivatives without those of the given texts."""
    return {name: tables[name].join(keys.select(*KEY).distinct(), KEY, "left_anti") for name in DERIVED}


def collect_garbage(tables: Tables, listing: DataFrame, root: str) -> Tables:
    """Paths gone from under the root go, then documents without any path, then what hangs on them."""
    gone = missing_paths(tables["paths"], listing, root)
    paths = tables["paths"].join(gone.select("path"), "path", "left_anti")
    documents = tables["documents"].join(paths.select("document_id"), "document_id", "left_semi")
    return tables | {"paths": paths, "documents": documents} | cascade(tables, documents)


def save_paths(paths: DataFrame, seen: DataFrame) -> DataFrame:
    """Known paths are re-pointed and keep their number; new ones follow in order of path."""
    old = paths.select("path", "path_seq")
    top = paths.agg(F.coalesce(F.max("path_seq"), F.lit(-1)).alias("top"))
    # numbers rise with the path and need not be dense, so a range sort deals them without a single task
    fresh = seen.join(old, "path", "left_anti").select("path").orderBy("path").withColumn("k", F.monotonically_increasing_id() + 1)
    numbered = fresh.crossJoin(F.broadcast(top)).select("path", (F.col("top") + F.col("k")).alias("path_seq"))
    now = seen.select("document_id", "path", "file_size", "modified_at").join(old.unionByName(numbered), "path")
    return paths.join(seen.select("path"), "path", "left_anti").unionByName(now.select(*paths.columns))


def scan(store: Store, root: str, extractor: Callable[[bytes, str], str] = source.decode, postprocess: Callable[..., Tables] | None = None, summary_model: str | None = None) -> DataFrame:
    """Take in what is new or changed under ``root``; the result counts outcomes (outcome, n).

    Unchanged, fully processed files are skipped, after their digest was compared. A file that cannot be read
    keeps an earlier text. ``postprocess`` gets the tables, the keys of the texts to derive anew, and ``Store.stage`` for what it reads again.
    """
    spark, tables = store.spark, store.tables()
    listing = source.list_files(spark, root, content=False)
    ready = processed_texts(tables, summary_model).select("document_id") if summary_model else tables["texts"].select("document_id")
    marked = diff_listing(listing, tables["paths"], ready).persist()
    work = marked.where("outcome <> 'unchanged'")
    # equal bytes are extracted once, from the first of their paths; only the files that need it are held with their bytes
    once = work.groupBy("document_id").agg(F.min("path").alias("path")).withColumnRenamed("document_id", "_id")
    held = source.list_files(spark, root).join(F.broadcast(once) if once.count() <= BROADCAST_ROWS else once, "path")
    read = source.extract(held.select(F.col("_id").alias("document_id"), "extension", "content", (F.col("document_id") != F.col("_id")).alias("moved")), extractor)
    read = read.withColumn("status", F.when(F.col("moved"), "error").otherwise(F.col("status"))).withColumn("error", F.when(F.col("moved"), "the file changed during the scan").otherwise(F.col("error"))).drop("moved").persist()
    good = read.where("status = 'ok'")
    had = tables["texts"].select("document_id").distinct()
    failed = read.where("status = 'error'").select("document_id", "extension")
    new_documents = good.select("document_id", "extension", F.lit("extracted").alias("status")).unionByName(
        failed.join(had, "document_id", "left_anti").select("document_id", "extension", F.lit("failed").alias("status"))
    )
    documents = tables["documents"].join(new_documents, "document_id", "left_anti").unionByName(new_documents)
    documents = documents.unionByName(failed.join(had, "document_id", "left_semi").join(documents, "document_id", "left_anti").select("document_id", "extension", F.lit("extracted").alias("status")))
    # what is gone is left out before anything is derived
    paths = save_paths(tables["paths"], work)
    paths = store.stage("paths", paths.where(~under(F.col("path"), root)).unionByName(paths.join(marked.select("path"), "path", "left_semi").where(under(F.col("path"), root)).select(*paths.columns)))
    documents = store.stage("documents", documents.join(paths.select("document_id").distinct(), "document_id", "left_semi"))
    tables = tables | {"documents": documents, "paths": paths} | cascade(tables, documents)
    old = tables["texts"]
    fresh = good.select("document_id", F.lit(EXTRACTOR).alias("extractor"), "extracted_text", clean(F.col("extracted_text")).alias("cleaned_text"), content_id(F.col("extracted_text")).alias("content_hash"))
    fresh = fresh.join(old.select(*KEY, F.col("content_hash").alias("_h"), F.col("light_keyword_count").alias("_n")), KEY, "left").withColumn("same", F.coalesce(F.col("_h") == F.col("content_hash"), F.lit(False)))
    fresh = fresh.persist()
    altered = fresh.where("not same and _h is not null").select(*KEY)
    texts = old.join(fresh.select(*KEY), KEY, "left_anti").unionByName(fresh.withColumn("light_keyword_count", F.when(F.col("same"), F.col("_n"))).select(*old.columns))
    state = tables | {"texts": store.stage("texts", texts)} | drop_derivatives(tables, altered)
    if postprocess:
        state = postprocess(state, fresh.select(*KEY), store.stage)
    counts = marked.join(read.select("document_id", "status"), "document_id", "left")
    counts = counts.select(F.when(F.col("outcome") == "unchanged", "skipped").when(F.col("status") == "ok", "extracted").otherwise("failed").alias("outcome"))
    counts = [tuple(r) for r in counts.groupBy("outcome").count().collect()]
    store.commit(state)
    for df in (marked, read, fresh):
        df.unpersist()
    return spark.createDataFrame(counts, "outcome string, n long")
