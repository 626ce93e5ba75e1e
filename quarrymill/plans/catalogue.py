"""Queries over the driver tables, each with the SQL that gives the same rows.

The driver's documents stand in for a store: path = source/lang/doc_id.txt, the document's id is the digest of its text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrymill.functions.text import clean, clean_normalised, content_id, preview
from quarrymill.functions.vectors import cosine_distance
from quarrymill.operators import chunking, embedding, ingest, keywords, merging, search, summaries
from quarrymill.store import stats

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
_PATHS = "source || '/' || lang || '/' || doc_id || '.txt' AS path, doc_id AS path_seq"
BASE = f"""
base AS (SELECT sha256(text) AS document_id, {_PATHS}, text FROM documents),
fp AS (SELECT document_id, arg_min(path, path_seq) AS path, min(path_seq) AS path_seq FROM base GROUP BY 1),
bodies AS (SELECT document_id, any_value(text) AS body FROM base GROUP BY 1)"""
_WORD = "[a-zà-ÿß]{5,}"
WORDS = f"""
tok AS (SELECT document_id, unnest(regexp_extract_all(lower(body), '{_WORD}')) AS value FROM bodies),
cnt AS (SELECT document_id, value, count(*) AS n FROM tok GROUP BY 1, 2),
light AS (SELECT document_id, 'ja-yake-v1' AS model_name, row_number() OVER (PARTITION BY document_id ORDER BY n DESC, value) AS rank, value, n / (n + 10.0) AS score FROM cnt),
fine AS (SELECT document_id, 'refined' AS model_name, row_number() OVER (PARTITION BY document_id ORDER BY length(value) DESC, value) AS rank, value FROM cnt JOIN fp USING (document_id) WHERE path_seq % 3 = 0),
links AS (SELECT * FROM light WHERE rank <= 10 UNION ALL SELECT *, 1.0 / (1 + rank) AS score FROM fine WHERE rank <= 5),
eff AS (SELECT * FROM links WHERE model_name = 'refined' UNION ALL SELECT * FROM links l WHERE model_name = 'ja-yake-v1' AND NOT EXISTS (SELECT 1 FROM links r WHERE r.document_id = l.document_id AND r.model_name = 'refined'))"""


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return read(spark, sf_dir, "documents").select(content_id(F.col("text")).alias("document_id"), path.alias("path"), F.col("doc_id").alias("path_seq"), "text")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each distinct text. Texts are one to an id, so the aggregate carries any of them."""
    return base(spark, sf_dir).groupBy("document_id").agg(F.any_value("text").alias("body")).select("document_id", F.lit("plain").alias("extractor"), "body")


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword links: the 10 most frequent words as the light model, for every third document the 5 longest as the refined."""
    tokens = texts(spark, sf_dir).select("document_id", F.explode(F.regexp_extract_all(F.lower("body"), F.lit(f"({_WORD})"), 1)).alias("value"))
    counted = tokens.groupBy("document_id", "value").agg(F.count(F.lit(1)).alias("n"))
    by = Window.partitionBy("document_id")
    light = counted.withColumn("rank", F.row_number().over(by.orderBy(F.desc("n"), "value"))).where("rank <= 10")
    light = light.select("document_id", F.lit(keywords.LIGHT_MODEL).alias("model_name"), "rank", "value", (F.col("n") / (F.col("n") + 10.0)).alias("score"))
    third = base(spark, sf_dir).groupBy("document_id").agg(F.min("path_seq").alias("s")).where("s % 3 = 0").select("document_id")
    fine = counted.join(third, "document_id", "left_semi").withColumn("rank", F.row_number().over(by.orderBy(F.desc(F.length("value")), "value"))).where("rank <= 5")
    fine = fine.select("document_id", F.lit("refined").alias("model_name"), "rank", "value", (F.lit(1.0) / (1 + F.col("rank"))).alias("score"))
    return light.unionByName(fine).withColumn("extractor", F.lit("plain"))


@query("dedupe_documents", f"WITH {BASE} SELECT document_id, count(*) AS n_paths, arg_min(path, path_seq) AS first_path FROM base GROUP BY 1")
def dedupe_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base(spark, sf_dir).groupBy("document_id").agg(F.count(F.lit(1)).alias("n_paths"), F.min_by("path", "path_seq").alias("first_path"))


def _searched(spark: SparkSession, sf_dir: str, text: str, keyworded: bool = False, top_k: int = 50, **options) -> DataFrame:
    paths = base(spark, sf_dir).select("document_id", "path", "path_seq")
    known = links(spark, sf_dir) if keyworded else spark.createDataFrame([], "document_id string, extractor string, model_name string, rank int, value string, score double")
    hits = search.keyword_search(texts(spark, sf_dir), paths, known, text, top_k, model_name="refined", **options)
    return hits.select("document_id", "path", "preview", *(["score", F.array_join("keywords", ",").alias("keywords")] if keyworded else []))


def _fold(x: str) -> str:
    return f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _search_sql(where: str, k: int = 50) -> str:
    shown = "substr(trim(regexp_replace(body, '\\s+', ' ', 'g')), 1, 240)"
    return f"WITH {BASE} SELECT document_id, path, {shown} AS preview FROM bodies JOIN fp USING (document_id) WHERE {where} ORDER BY document_id LIMIT {k}"


_F = _fold("body")
for _name, _text, _where, _options in [
    ("kw_and", "the WITH", f"contains({_F}, 'the') AND contains({_F}, 'with')", {}),
    ("kw_or", "que heit", f"contains({_F}, 'que') OR contains({_F}, 'heit')", {"operator": "or"}),
    ("kw_not", "the -with -of", f"contains({_F}, 'the') AND NOT contains({_F}, 'with') AND NOT contains({_F}, 'of')", {}),
    ("kw_phrase", '"in the"', f"contains({_F}, 'in the')", {}),
    ("kw_path", "e", f"contains({_F}, 'e') AND contains({_fold('path')}, 'src1')", {"path_filter": "SRC1"}),
    ("kw_directory", "e", f"contains({_F}, 'e') AND starts_with({_fold('path')}, 'src1/en/')", {"directory": "src1\\en/"}),
    ("kw_extension", "der", f"contains({_F}, 'der') AND ends_with({_fold('path')}, '.txt')", {"extension": "txt"}),
    ("kw_literal_wildcards", "%", f"contains({_F}, '%')", {}),
]:
    query(_name, _search_sql(_where))(lambda spark, sf_dir, t=_text, o=_options: _searched(spark, sf_dir, t, **o))

_HIT = "contains(value, 'tion')"


@query("kw_ranked", f"""WITH {BASE}, {WORDS},
agg AS (SELECT document_id, max(CASE WHEN {_HIT} THEN score END) AS score, string_agg(value, ',' ORDER BY rank) AS keywords, bool_or({_HIT}) AS hit FROM eff GROUP BY 1)
SELECT document_id, path, substr(trim(regexp_replace(body, '\\s+', ' ', 'g')), 1, 240) AS preview, score, coalesce(keywords, '') AS keywords
FROM bodies JOIN fp USING (document_id) LEFT JOIN agg USING (document_id) WHERE contains({_F}, 'tion') OR coalesce(hit, false)
ORDER BY score DESC NULLS LAST, document_id LIMIT 50""")  # fmt: skip
def kw_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _searched(spark, sf_dir, "tion", keyworded=True)


@query("effective_keywords", f"WITH {BASE}, {WORDS} SELECT document_id, model_name, rank, value, score FROM eff")
def effective_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keywords.effective_keywords(links(spark, sf_dir), "refined").select("document_id", "model_name", "rank", "value", "score")


_FOUND_SQL = "found AS (SELECT 'd' || doc_id % 50 AS document_id, unnest(regexp_extract_all(lower(text), '[a-z]{7,}')) AS value, doc_id % 61 / 64.0 AS score FROM documents)"
_SCORE_SQL = "least(1.0, round(max(score) + least(count(*) - 1, 4) * 0.01, 6))"


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents")
    return rows.select(F.concat(F.lit("d"), (F.col("doc_id") % 50).cast("string")).alias("document_id"), F.lit("plain").alias("extractor"), F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{7,})"), 1)).alias("value"), (F.col("doc_id") % 61 / 64.0).alias("score"))


@query("keyword_aggregate", f"WITH {_FOUND_SQL} SELECT document_id, value, {_SCORE_SQL} AS score FROM found GROUP BY 1, 2")
def keyword_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keywords.aggregate_keywords(_found(spark, sf_dir), 1 << 30).select("document_id", "value", "score")


@query("keyword_topn", f"""WITH {_FOUND_SQL}, s AS (SELECT document_id, value, {_SCORE_SQL} AS score FROM found GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY score DESC, value) AS rank FROM s) SELECT document_id, rank, value, score FROM r WHERE rank <= 10""")  # fmt: skip
def keyword_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keywords.aggregate_keywords(_found(spark, sf_dir), 10).select("document_id", "rank", "value", "score")


@query("term_frequency_candidates", """WITH t AS (SELECT doc_id AS key, regexp_extract_all(lower(text), '[a-zà-ÿß]{2,}') AS w FROM documents),
u AS (SELECT key, unnest(w) AS term, generate_subscripts(w, 1) - 1 AS pos FROM t), c AS (SELECT key, term, count(*) AS n, min(pos) AS first_pos FROM u GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY n DESC, first_pos) AS rank FROM c) SELECT key, term, n, rank FROM r WHERE rank <= 500""")  # fmt: skip
def term_frequency_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), F.posexplode(F.regexp_extract_all(F.lower("text"), F.lit("([a-zà-ÿß]{2,})"), 1)).alias("pos", "term"))
    return keywords.term_candidates(tokens).select("key", "term", "n", "rank")


_COS = "1 - list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)) / (sqrt(list_sum(list_transform(e.embedding, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(q.embedding, lambda x: x::DOUBLE * x::DOUBLE))))"


def _distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances of all vectors to the one numbered 0; the query vector is a scalar subquery, so one row."""
    vectors = read(spark, sf_dir, "embeddings")
    one = vectors.where("vec_id = 0").agg(F.first("embedding").alias("q"))
    return vectors.crossJoin(F.broadcast(one)).select("vec_id", "label", cosine_distance(F.col("embedding"), F.col("q")).alias("d"))


@query("knn_cosine", f"SELECT vec_id, round(d, 4) + 0.0 AS distance FROM (SELECT e.vec_id, {_COS} AS d FROM embeddings e, embeddings q WHERE q.vec_id = 0) ORDER BY d, vec_id LIMIT 50")
def knn_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _distances(spark, sf_dir).orderBy("d", "vec_id").limit(50).select("vec_id", (F.round("d", 4) + 0.0).alias("distance"))


@query("knn_per_label", f"SELECT label, arg_min(vec_id, (d, vec_id)) AS vec_id, round(min(d), 4) + 0.0 AS distance FROM (SELECT e.vec_id, e.label, {_COS} AS d FROM embeddings e, embeddings q WHERE q.vec_id = 0) GROUP BY 1")
def knn_per_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _distances(spark, sf_dir).groupBy("label").agg(F.min_by("vec_id", F.struct("d", "vec_id")).alias("vec_id"), (F.round(F.min("d"), 4) + 0.0).alias("distance"))


@query("hybrid_rrf", f"""WITH {BASE}, {WORDS}, agg AS (SELECT document_id, max(CASE WHEN {_HIT} THEN score END) AS score, bool_or({_HIT}) AS hit FROM eff GROUP BY 1),
k AS (SELECT document_id, score FROM bodies LEFT JOIN agg USING (document_id) WHERE contains({_F}, 'tion') OR coalesce(hit, false) ORDER BY score DESC NULLS LAST, document_id LIMIT 50),
kr AS (SELECT document_id, row_number() OVER (ORDER BY score DESC NULLS LAST, document_id) AS rank FROM k),
n AS (SELECT e.vec_id, {_COS} AS d FROM embeddings e, embeddings q WHERE q.vec_id = 0),
nn AS (SELECT sha256(text) AS document_id, d FROM (SELECT d.text, n.d, n.vec_id FROM n JOIN documents d ON d.doc_id = n.vec_id ORDER BY n.d, sha256(d.text), n.vec_id LIMIT 50)),
nb AS (SELECT document_id, min(d) AS d FROM nn GROUP BY 1), nr AS (SELECT document_id, row_number() OVER (ORDER BY d, document_id) AS rank FROM nb),
f AS (SELECT document_id, sum(1.0 / (60 + rank)) AS rrf FROM (SELECT * FROM kr UNION ALL SELECT * FROM nr) GROUP BY 1)
SELECT document_id, round(rrf, 8) AS rrf FROM f ORDER BY f.rrf DESC, document_id LIMIT 10""")  # fmt: skip
def hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = base(spark, sf_dir)
    paths, bodies = stored.select("document_id", "path", "path_seq"), texts(spark, sf_dir)
    query_vector = read(spark, sf_dir, "embeddings").where("vec_id = 0").first()["embedding"]
    vectors = read(spark, sf_dir, "embeddings").join(stored.select("document_id", F.col("path_seq").alias("vec_id")), "vec_id")
    vectors = vectors.select("document_id", F.lit("plain").alias("extractor"), F.col("vec_id").cast("int").alias("chunk_index"), F.col("embedding").alias("vector"))
    near = search.vector_search(vectors, bodies, paths, query_vector, top_k=50)
    hits = search.keyword_search(bodies, paths, links(spark, sf_dir), "tion", 50, model_name="refined")
    return search.fuse(hits, near).select("document_id", F.round("rrf", 8).alias("rrf"))


@query("worklist_chunks", f"WITH {BASE} SELECT document_id FROM bodies WHERE document_id NOT IN (SELECT document_id FROM base WHERE path_seq % 4 <> 0)")
def worklist_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = base(spark, sf_dir).where("path_seq % 4 <> 0").select("document_id", F.lit("plain").alias("extractor"), F.lit(chunking.VERSION).alias("chunker_version"))
    return chunking.missing_chunks(texts(spark, sf_dir), done).select("document_id")


@query("worklist_embed", f"WITH {BASE} SELECT document_id, path_seq AS chunk_index FROM base WHERE path_seq NOT IN (SELECT vec_id FROM embeddings)")
def worklist_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = base(spark, sf_dir).select("document_id", F.lit("plain").alias("extractor"), F.col("path_seq").alias("chunk_index"))
    vectors = chunks.join(read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_index")), "chunk_index", "left_semi").withColumn("model_name", F.lit("m"))
    return embedding.missing_embeddings(chunks, vectors, "m").select("document_id", "chunk_index")


_AFTER = "SELECT path, CASE WHEN path_seq % 11 = 0 THEN sha256(text || '!') ELSE document_id END AS document_id FROM base WHERE path_seq % 7 <> 0"


def _listings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """What is stored, and a later listing: every seventh file gone, every eleventh altered."""
    before = base(spark, sf_dir).withColumns({"file_size": F.length("text").cast("long"), "modified_at": F.timestamp_seconds("path_seq")})
    now = F.when(F.col("path_seq") % 11 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    after = before.where("path_seq % 7 <> 0").withColumn("document_id", content_id(now))
    return before.drop("text"), after.drop("text", "path_seq")


@query("scan_diff", f"WITH {BASE}, a AS ({_AFTER}) SELECT a.path, a.document_id, CASE WHEN a.document_id = b.document_id THEN 'unchanged' ELSE 'changed' END AS outcome FROM a JOIN base b USING (path)")
def scan_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, after = _listings(spark, sf_dir)
    return ingest.diff_listing(after, before).select("path", "document_id", "outcome")


@query("gc_missing_paths", f"WITH {BASE} SELECT path, document_id FROM base WHERE path_seq % 7 = 0 AND starts_with(path, 'src1/')")
def gc_missing_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, after = _listings(spark, sf_dir)
    return ingest.missing_paths(before, after, "src1").select("path", "document_id")


@query("gc_orphans", f"WITH {BASE} SELECT DISTINCT document_id FROM base WHERE document_id NOT IN (SELECT document_id FROM base WHERE path_seq % 7 <> 0)")
def gc_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, after = _listings(spark, sf_dir)
    left = before.join(after.select("path"), "path", "left_semi")
    return ingest.orphans(before.select("document_id").distinct(), left)


@query("gc_cascade", f"WITH {BASE}, {WORDS} SELECT document_id, model_name, rank, value FROM links WHERE document_id IN (SELECT document_id FROM base WHERE path_seq % 7 <> 0)")
def gc_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, after = _listings(spark, sf_dir)
    left = before.join(after.select("path"), "path", "left_semi")
    known = {name: links(spark, sf_dir) for name in ("texts", *ingest.DERIVED)}
    return ingest.cascade(known, left)["keywords"].select("document_id", "model_name", "rank", "value")


_L, _R = "path_seq % 3 <> 0", "path_seq % 2 = 0"


@query("merge_documents", f"WITH {BASE} SELECT path, document_id, CASE WHEN {_L} THEN 'target' ELSE 'source' END AS side FROM base WHERE {_L} OR {_R}")
def merge_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = base(spark, sf_dir).drop("text")
    return merging.add_missing(rows.where(_L).withColumn("side", F.lit("target")), rows.where(_R).withColumn("side", F.lit("source")), ["path"]).select("path", "document_id", "side")


def _cut_sql(where: str, n: int) -> str:
    return f"SELECT document_id, i AS chunk_index, sha256(substr(body, i * {n} + 1, {n})) AS content_hash FROM (SELECT document_id, body, unnest(range(0, (length(body) + {n - 1}) // {n})) AS i FROM (SELECT DISTINCT document_id, text AS body FROM base WHERE {where}))"


def _cut_chunks(spark: SparkSession, sf_dir: str, where: str, n: int) -> DataFrame:
    rows = base(spark, sf_dir).where(where).select("document_id", F.lit("plain").alias("extractor"), F.col("text").alias("body")).dropDuplicates(["document_id"]).where("length(body) > 0")
    places = F.explode(F.sequence(F.lit(0), F.floor((F.length("body") - 1) / n).cast("int"))).alias("chunk_index")
    return rows.select("document_id", "extractor", "body", places).select("document_id", "extractor", "chunk_index", content_id(F.substring(F.col("body"), F.col("chunk_index") * n + 1, F.lit(n))).alias("content_hash"))


@query("merge_chunks", f"""WITH {BASE}, t AS ({_cut_sql(_L, 500)}), s AS ({_cut_sql(_R, 400)})
SELECT document_id, chunk_index, content_hash FROM t UNION ALL SELECT document_id, chunk_index, content_hash FROM s
WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.document_id = s.document_id AND t.chunk_index = s.chunk_index) AND NOT EXISTS (SELECT 1 FROM t WHERE t.document_id = s.document_id AND t.content_hash = s.content_hash)""")  # fmt: skip
def merge_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merging.merge_chunks(_cut_chunks(spark, sf_dir, _L, 500), _cut_chunks(spark, sf_dir, _R, 400)).select("document_id", "chunk_index", "content_hash")


@query("merge_keywords", f"""WITH {BASE}, {WORDS}, t AS (SELECT * FROM links WHERE document_id IN (SELECT document_id FROM base WHERE {_L})), s AS (SELECT * FROM links WHERE document_id IN (SELECT document_id FROM base WHERE {_R}) AND rank <> 2)
SELECT document_id, model_name, rank, value FROM t UNION ALL SELECT document_id, model_name, row_number() OVER (PARTITION BY document_id, model_name ORDER BY rank) AS rank, value FROM s
WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.document_id = s.document_id AND t.model_name = s.model_name)""")  # fmt: skip
def merge_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    known, stored = links(spark, sf_dir), base(spark, sf_dir)
    target = known.join(stored.where(_L).select("document_id"), "document_id", "left_semi")
    source = known.join(stored.where(_R).select("document_id"), "document_id", "left_semi").where("rank <> 2")
    return merging.merge_keywords(target, source).select("document_id", "model_name", "rank", "value")


@query("store_stats", "SELECT 'documents' AS name, count(*) AS n FROM documents UNION ALL SELECT 'embeddings', count(*) FROM embeddings UNION ALL SELECT 'pages', count(*) FROM pages UNION ALL SELECT 'conversations', count(*) FROM conversations")
def store_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats({t: read(spark, sf_dir, t) for t in ("documents", "embeddings", "pages", "conversations")})


_NOISE_SQL = """CASE doc_id % 8 WHEN 1 THEN replace(text, chr(10), chr(13) || chr(10)) WHEN 2 THEN replace(text, 'e', 'e' || chr(7)) WHEN 3 THEN regexp_replace(text, '([a-z])([a-z]) ', '\\1-' || chr(10) || ' \\2 ', 'g')
WHEN 4 THEN replace(text, chr(10), '  ' || chr(9) || chr(10)) WHEN 5 THEN replace(text, '. ', '.' || chr(10) || chr(10) || chr(10) || chr(10)) WHEN 6 THEN replace(text, ' ', chr(160)) ELSE text END"""


def _noise(text: Column, doc_id: Column) -> Column:
    k = doc_id % 8
    return (
        F.when(k == 1, F.replace(text, F.lit("\n"), F.lit("\r\n"))).when(k == 2, F.replace(text, F.lit("e"), F.lit("e\x07")))
        .when(k == 3, F.regexp_replace(text, "([a-z])([a-z]) ", "$1-\n $2 ")).when(k == 4, F.replace(text, F.lit("\n"), F.lit("  \t\n")))
        .when(k == 5, F.replace(text, F.lit(". "), F.lit(".\n\n\n\n"))).when(k == 6, F.replace(text, F.lit(" "), F.lit(" "))).otherwise(text)
    )



_CLEAN_SQL = r"""a AS (SELECT doc_id, replace(replace(replace(t, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(160), ' ') AS t FROM n),
b AS (SELECT doc_id, regexp_replace(t, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g') AS t FROM a),
c AS (SELECT doc_id, regexp_replace(regexp_replace(t, '([A-Za-z])-\s*\n\s*([A-Za-z])', '\1\2', 'g'), '([A-Za-z])-\s*\n\s*([A-Za-z])', '\1\2', 'g') AS t FROM b),
d AS (SELECT doc_id, regexp_replace(regexp_replace(t, '[ \t]+(\n|$)', '\1', 'g'), '\n\n\n+', chr(10) || chr(10), 'g') AS t FROM c) SELECT doc_id, sha256(trim(t, ' ' || chr(10) || chr(9))) AS cleaned FROM d"""


@query("clean_text_noise", f"WITH n AS (SELECT doc_id, {_NOISE_SQL} AS t FROM documents), {_CLEAN_SQL}")
def clean_text_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cleaning steps after NFKC; that and the Japanese steps have literal tests."""
    rows = read(spark, sf_dir, "documents")
    return rows.select("doc_id", content_id(clean_normalised(_noise(F.col("text"), F.col("doc_id")))).alias("cleaned"))


@query("preview", r"SELECT doc_id, substr(trim(regexp_replace(text, '\s+', ' ', 'g')), 1, 240) AS preview FROM documents")
def preview_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", preview(F.col("text"), 240).alias("preview"))


@query("chunk_documents")
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_texts(texts(spark, sf_dir)).select("document_id", "chunk_index", "content", "content_hash", "character_count")


@query("chunk_stats")
def chunk_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_documents(spark, sf_dir).groupBy("document_id").agg(F.count(F.lit(1)).alias("chunks"), F.min("character_count").alias("shortest"), F.max("character_count").alias("longest"))


def _light(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = chunking.chunk_texts(texts(spark, sf_dir))
    return keywords.aggregate_keywords(keywords.chunk_keywords(chunks, keywords.LightExtractor), 10)


@query("light_keywords")
def light_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _light(spark, sf_dir).select("document_id", "rank", "value", "score")


@query("refined_keywords")
def refined_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = chunking.chunk_texts(texts(spark, sf_dir))
    found = keywords.chunk_keywords(chunks, lambda: keywords.RefinedExtractor(embedding.HashedEncoder(64).encode), 10)
    return keywords.aggregate_keywords(found, 10, keywords.REFINED_MODEL).select("document_id", "rank", "value", "score")


@query("extractive_summary")
def extractive_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.provisional_summaries(texts(spark, sf_dir), links(spark, sf_dir).where(F.col("model_name") == keywords.LIGHT_MODEL)).select("document_id", "model_name", "summary")


_COUNTED = summaries.SummaryConfig()


class _Counting:
    """A chat model that answers with the number of calls that its input took, its own included."""

    def complete(self, system: str, user: str) -> str:
        text = user.removeprefix(_COUNTED.reduce_prompt)
        return str(1 + (sum(map(int, text.split())) if text != user else 0))


@query("llm_reduce_shape", """WITH RECURSIVE n AS (SELECT doc_id, least(50, ceil(length(text) / 1200.0))::INT AS k FROM documents), r AS (SELECT doc_id, k, k AS calls FROM n UNION ALL SELECT doc_id, ceil(k / 6.0)::INT, calls + ceil(k / 6.0)::INT FROM r WHERE k > 1)
SELECT doc_id, max(calls) AS calls FROM r GROUP BY 1""")  # fmt: skip
def llm_reduce_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completions that each document takes when its text is cut every 1200 characters: the operator runs, with a model that counts."""
    places = F.sequence(F.lit(0), F.ceil(F.length("text") / 1200.0).cast("int") - 1)
    rows = read(spark, sf_dir, "documents").where("length(text) > 0").select("doc_id", F.explode(places).alias("chunk_index"))
    chunks = rows.select(F.col("doc_id").cast("string").alias("document_id"), F.lit("plain").alias("extractor"), "chunk_index", F.lit("part").alias("content"))
    done = summaries.map_reduce_summaries(chunks, _Counting, _COUNTED)
    none = read(spark, sf_dir, "documents").where("coalesce(length(text), 0) = 0").select("doc_id", F.lit(0).alias("calls"))
    return done.select(F.col("document_id").cast("long").alias("doc_id"), F.col("summary").cast("int").alias("calls")).unionByName(none)


@query("embed_chunks")
def embed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding.embed(chunking.chunk_texts(texts(spark, sf_dir)), embedding.HashedEncoder)


@query("clean_documents", f"WITH n AS (SELECT doc_id, text AS t FROM documents), {_CLEAN_SQL}")
def clean_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaning as a whole. The SQL lacks NFKC and the Japanese steps, which change nothing in the driver's tables and have literal tests."""
    return read(spark, sf_dir, "documents").select("doc_id", content_id(clean(F.col("text"))).alias("cleaned"))
