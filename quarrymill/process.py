"""What follows extraction and enrichment commands: derive, store, count."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.operators import chunking, embedding, keywords, summaries
from quarrymill.store import Store, Tables, processing_text

KEY = ["document_id", "extractor"]


def postprocess(tables: Tables, fresh: DataFrame, stage: Callable[[str, DataFrame], DataFrame] = lambda name, df: df) -> Tables:
    """Chunks of texts that lack this version's, light keywords and provisional summaries of ``fresh`` texts.

    ``stage`` writes a table that others are made of, so that each is computed once.
    """
    keys = fresh.select(*KEY).distinct()
    bodies = processing_text(tables["texts"]).join(keys, KEY, "left_semi")
    lacking = chunking.missing_chunks(bodies, tables["chunks"])
    anew = lacking.select(*KEY)
    chunks = stage("chunks", tables["chunks"].join(anew, KEY, "left_anti").unionByName(chunking.chunk_texts(lacking).select(*tables["chunks"].columns)))
    found = keywords.aggregate_keywords(keywords.chunk_keywords(chunks.join(keys, KEY, "left_semi"), keywords.LightExtractor))
    old = tables["keywords"].join(keys.withColumn("model_name", F.lit(keywords.LIGHT_MODEL)), [*KEY, "model_name"], "left_anti")
    links = stage("keywords", old.unionByName(found.select(*old.columns)))
    light = links.where(F.col("model_name") == keywords.LIGHT_MODEL).join(keys, KEY, "left_semi")
    counts = light.groupBy(*KEY).agg(F.count(F.lit(1)).cast("int").alias("_n"))
    texts = tables["texts"].join(keys.withColumn("_fresh", F.lit(True)), KEY, "left").join(counts, KEY, "left")
    texts = texts.withColumn("light_keyword_count", F.when(F.col("_fresh"), F.coalesce("_n", F.lit(0))).otherwise(F.col("light_keyword_count"))).select(*tables["texts"].columns)
    provisional = summaries.provisional_summaries(bodies, light)
    return tables | {
        "texts": texts, "chunks": chunks, "keywords": links, "embeddings": tables["embeddings"].join(anew, KEY, "left_anti"),
        "summaries": summaries.replace_provisional(tables["summaries"], provisional),
    }


def refine(store: Store, make: Callable[[], keywords.KeywordExtractor], config: keywords.KeywordConfig | None = None, all_items: bool = False) -> dict[str, int]:
    """Refined keywords of the texts that lack them."""
    config, tables = config or keywords.KeywordConfig(), store.tables()
    bodies = processing_text(tables["texts"])
    work = bodies.where(F.trim("body") != "") if all_items else keywords.missing_keywords(bodies, tables["keywords"], config.model_name)
    have = tables["chunks"].join(work.select(*KEY), KEY, "left_semi")
    chunks = have.select(*KEY, "chunk_index", "content").unionByName(chunking.chunk_texts(work.join(have.select(*KEY).distinct(), KEY, "left_anti")).select(*KEY, "chunk_index", "content"))
    new = keywords.aggregate_keywords(keywords.chunk_keywords(chunks, make, config.top_n), config.top_n, config.model_name).persist()
    counts = {"documents": new.select(*KEY).distinct().count(), "keywords": new.count()}
    store.commit({"keywords": keywords.replace_links(tables["keywords"], new.select(*tables["keywords"].columns))})
    new.unpersist()
    return counts


def summarize(store: Store, make: Callable[[], summaries.Completer], config: summaries.SummaryConfig | None = None, all_items: bool = False) -> dict[str, int]:
    """Model summaries of the texts that lack them; failures are counted, not stored, and tried again next time."""
    config, tables = config or summaries.SummaryConfig(), store.tables()
    bodies = processing_text(tables["texts"])
    work = bodies if all_items else summaries.missing_summaries(bodies, tables["summaries"], config.model, config.prompt_version)
    have = tables["chunks"].join(work.select(*KEY), KEY, "left_semi").select(*KEY, "chunk_index", "content")
    chunks = have.unionByName(chunking.chunk_texts(work.join(have.select(*KEY).distinct(), KEY, "left_anti")).select(*KEY, "chunk_index", "content"))
    got = summaries.map_reduce_summaries(chunks, make, config).persist()
    good = got.where("summary is not null")
    prompt = F.lit(config.prompt_version)
    rows = good.select(*KEY, F.lit(config.model).alias("model_name"), F.lit(config.endpoint).alias("endpoint"), prompt.alias("prompt_version"), "summary", summaries.work_key(F.col("document_id"), F.lit(config.model), prompt).alias("work_key"))
    counts = {"documents": good.count(), "failed": got.where("summary is null").count()}
    store.commit({"summaries": summaries.replace_summaries(tables["summaries"], rows)})
    got.unpersist()
    return counts


def embed(store: Store, make: Callable[[], embedding.Encoder], config: embedding.EmbeddingConfig | None = None, all_items: bool = False) -> int:
    """Vectors of the chunks that lack them; the number of new ones."""
    config, tables = config or embedding.EmbeddingConfig(), store.tables()
    old = tables["embeddings"].where(F.col("model_name") != config.model_name) if all_items else tables["embeddings"]
    new = embedding.embed(embedding.missing_embeddings(tables["chunks"], old, config.model_name), make, config).persist()
    n = new.count()
    store.commit({"embeddings": embedding.add_embeddings(old, new)})
    new.unpersist()
    return n
