"""Benchmark decontamination by template canonicalisation.

Numbers, names and units become typed slots; windows of the resulting template tokens are hash-joined with the
benchmark's, and a match counts if its slots are consistent: one filler of the item always meets the same filler in
the document. So a question with other numbers or names in it is found, and one that only looks alike is not.

Native: DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.llm.cluster import BROADCAST_ROWS, cut, semi_by_key

WINDOW = 8
MIN_LITERALS = 4
MIN_COVERAGE = 0.3
#: Slot marks, of the private use area; what follows a mark in a token is its filler.
NAME, NUMBER, UNIT = "", "", ""
UNITS = "mg|g|kg|t|lb|lbs|oz|mm|cm|m|km|in|inch|inches|ft|feet|yd|yards?|mi|miles?|ml|l|liters?|litres?|gal|gallons?|s|sec|seconds?|min|minutes?|h|hrs?|hours?|days?|weeks?|months?|years?|hz|khz|mhz|ghz|kb|mb|gb|tb|w|kw|v|a|j|kj|cal|kcal|pa|kpa|bar|k|degrees?|percent|usd|eur|gbp|dollars?|euros?|pounds?|cents?|kmh|mph"


def marked(text: Column) -> Column:
    """Lower-cased text whose slot tokens begin with their mark; signs other than letters and digits are dropped."""
    text = F.coalesce(text, F.lit(""))
    text = F.regexp_replace(text, f"[{NAME}-{UNIT}]", "")
    # a capitalised word within a sentence is a name; one after a stop, a colon or a line's end is not
    text = F.regexp_replace(text, r"(?<=[^\s.!?:;][ \t])(?=\p{Lu}\p{Ll})", NAME)
    text = F.regexp_replace(text, r"(?<!\S)[^\p{L}\p{N}\s]*(?=\S*\p{N})", NUMBER)
    text = F.regexp_replace(text, rf"(?i)(?<=\p{{N}}[ \t])(?=(?:{UNITS})(?:[\s,.;:!?)]|$))", UNIT)
    return F.lower(F.regexp_replace(text, rf"[^\p{{L}}\p{{N}}\s{NAME}-{UNIT}]+", ""))


def tokens(text: Column) -> Column:
    return F.filter(F.split(text, r"[\s\x85\xa0]+"), lambda t: t != "")


def template(text: Column) -> Column:
    """Marked text with the fillers taken out."""
    return F.regexp_replace(text, rf"([{NAME}-{UNIT}])[^\s\x85\xa0]*", "$1")  # up to where tokens end, so places agree with the marked text's


def _needed(size: Column | int) -> Column:
    """Plain tokens that let a window match with other fillers; one of fewer matches with its own fillers only."""
    return F.greatest(F.lit(1), F.least(F.lit(MIN_LITERALS), (F.lit(size) if isinstance(size, int) else size) - 1))


def _verbatim_places(toks: Column, size: int) -> Column:
    """Places of the windows with too few plain tokens, from the places of the slots: those where ``many`` slots lie within ``size`` tokens."""
    many = size - max(1, min(MIN_LITERALS, size - 1)) + 1
    slots = F.filter(F.transform(toks, lambda t, i: F.when(t.isin(NAME, NUMBER, UNIT), i)), lambda i: i.isNotNull())

    def around(places: Column) -> Column:
        firsts = F.when(F.size(places) >= many, F.sequence(F.lit(0), F.size(places) - many))
        first, last = lambda k: F.get(places, k), lambda k: F.get(places, k + (many - 1))
        near = F.filter(firsts, lambda k: last(k) - first(k) < size)
        return F.transform(near, lambda k: F.sequence(F.greatest(F.lit(0), last(k) - (size - 1)), F.least(first(k), F.size(toks) - size)))

    # the slots are found once, as the only element of an array
    found = F.get(F.transform(F.array(slots), around), F.lit(0))
    return F.when(F.size(toks) >= size, F.array_distinct(F.flatten(found)))


def _windows(toks: Column, size: int) -> Column:
    """Hashes of windows of ``size`` tokens at every place, so that what coverage counts is also what is looked for."""
    places = F.when(F.size(toks) >= size, F.sequence(F.lit(0), F.size(toks) - size))
    return F.transform(places, lambda j: F.xxhash64(F.slice(toks, j + 1, size)))


def _verbatim(own: Column, places: Column, size: int) -> Column:
    return F.transform(places, lambda j: F.xxhash64(F.slice(own, j + 1, size)))


def _numbered(toks: Column, size: int) -> Column:
    places = F.when(F.size(toks) >= size, F.sequence(F.lit(0), F.size(toks) - size))
    return F.transform(places, lambda j: F.struct(j.alias("at"), F.xxhash64(F.slice(toks, j + 1, size)).alias("h")))


def _numbered_verbatim(own: Column, places: Column, size: int) -> Column:
    return F.transform(places, lambda j: F.struct(j.alias("at"), F.xxhash64(F.slice(own, j + 1, size)).alias("h")))


def benchmark_matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """One row for each (document, item) that match: doc_id, item_id, windows, item_windows, coverage, slots, consistent, contaminated.

    ``windows`` counts the item's windows that the document holds in the consistent alignments (in any, if none
    is), ``coverage`` is their share of the item's, ``slots`` the distinct slots filled in them. ``contaminated``:
    consistent and with ``coverage`` at least ``min_coverage``.

    Items of fewer than 8 tokens are one window of all of them. Windows of under 4 plain tokens (all but one in
    shorter items, one at least) match with equal fillers only, so tables of other numbers do not match each other.
    If the share of the item's other windows is the greater one, ``windows``, ``item_windows`` and ``coverage`` are
    of those alone: they are all that a document with other fillers can hold. Null and empty texts on either
    side match nothing. Repeated items are reported each; rows that repeat a document id count as one document.
    Null ids match nothing. An empty table gives an empty result. Only the named columns are read.
    """
    items = benchmark.where(F.col(item_col).isNotNull()).select(F.col(item_col).alias("item_id"), marked(F.col(item_text_col)).alias("m"))
    items = items.select("item_id", tokens(F.col("m")).alias("own"), tokens(template(F.col("m"))).alias("toks")).where(F.size("toks") > 0)
    items = cut(items.withColumn("size", F.least(F.lit(WINDOW), F.size("toks"))).withColumn("n", F.size("toks") - F.col("size") + 1))
    part = lambda j: F.slice("toks", j + 1, F.col("size"))
    fill = lambda j: F.slice("own", j + 1, F.col("size"))
    free = lambda j: F.size(F.filter(part(j), lambda t: ~t.isin(NAME, NUMBER, UNIT))) >= _needed(F.col("size"))
    every = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda j: F.struct(j.alias("ipos"), free(j).alias("free"), F.when(free(j), F.xxhash64(part(j))).otherwise(F.xxhash64(fill(j))).alias("h"), fill(j).alias("ifill")))
    windows = items.select("item_id", "size", "n", every.alias("w")).withColumn("n_free", F.size(F.filter("w", lambda x: x["free"])))
    windows = cut(windows.select("item_id", "size", "n", "n_free", F.explode("w").alias("w")).select("item_id", "size", "n", "n_free", "w.*"))
    sizes = [r["size"] for r in windows.select("size").distinct().limit(WINDOW).collect()]

    read = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    both = lambda rows: rows.select("doc_id", marked(F.col("text")).alias("m")).select("doc_id", "m", tokens(template(F.col("m"))).alias("toks")).select("*", *[_verbatim_places(F.col("toks"), s).alias(f"at{s}") for s in sorted(sizes)])
    some = F.lit(False)
    for s in sizes:
        some = some | (F.size(f"at{s}") > 0)
    toks = both(read).withColumn("own", F.when(some, tokens(F.col("m"))))
    none = F.array().cast("array<bigint>")
    parts = [F.coalesce(x, none) for s in sorted(sizes) for x in (_windows(F.col("toks"), s), _verbatim(F.col("own"), F.col(f"at{s}"), s))]
    hashes = F.array_distinct(F.flatten(F.array(*parts))) if parts else none
    known = cut(windows.select("h").distinct())
    met = semi_by_key(toks.select("doc_id", F.explode(hashes).alias("h")), known, "h").select("doc_id").distinct()
    met = cut(met).select(F.col("doc_id").alias("doc_id"))  # a name of its own, as Spark cannot tell it from the table's in the join below

    # the documents met are read once more, now with all their windows and the fillers of their slots
    own = both(semi_by_key(read, met, "doc_id")).withColumn("own", tokens(F.col("m")))
    none = F.array().cast("array<struct<at:int,h:bigint>>")
    parts = [F.coalesce(x, none) for s in sorted(sizes) for x in (_numbered(F.col("toks"), s), _numbered_verbatim(F.col("own"), F.col(f"at{s}"), s))]
    every = F.flatten(F.array(*parts)) if parts else none
    at = own.select("doc_id", "own", F.explode(every).alias("w")).select("doc_id", F.col("w.at").alias("dpos"), F.col("w.h").alias("h"), F.slice("own", F.col("w.at") + 1, WINDOW).alias("dfill"))
    n_windows = windows.count()
    side = windows.select("item_id", "size", "n", "n_free", "free", "ipos", "h", "ifill")
    pairs = at.join(F.broadcast(side) if n_windows <= BROADCAST_ROWS // 4 else side, "h")
    slots = F.filter(F.zip_with("ifill", F.slice("dfill", 1, F.size("ifill")), lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda x: x["a"].rlike(f"^[{NAME}-{UNIT}]"))
    pairs = cut(pairs.select("doc_id", "item_id", "n", "n_free", "free", "ipos", (F.col("dpos") - F.col("ipos")).alias("shift"), slots.alias("slots")))
    key = ["doc_id", "item_id", "shift"]
    fills = pairs.select(*key, F.explode("slots").alias("s")).select(*key, F.col("s.a").alias("a"), F.col("s.b").alias("b"))
    odd = fills.groupBy(*key, "a").agg((F.min("b") != F.max("b")).alias("odd")).groupBy(*key).agg(F.max("odd").alias("odd"), F.count(F.lit(1)).alias("slots"))
    runs = pairs.drop("slots").join(odd, key, "left").withColumn("ok", ~F.coalesce("odd", F.lit(False)))
    by_window = runs.groupBy("doc_id", "item_id", "n", "n_free", "free", "ipos").agg(F.max("ok").alias("ok"), F.max(F.coalesce("slots", F.lit(0))).alias("slots"))
    total = lambda of: F.sum(of.cast("long"))
    ok, free = F.col("ok"), F.col("free")
    got = by_window.groupBy("doc_id", "item_id", "n", "n_free").agg(F.max("ok").alias("consistent"), total(ok).alias("fit"), total(ok & free).alias("fit_free"), F.count(F.lit(1)).alias("all"), total(free).alias("all_free"), F.max("slots").alias("slots"))
    count, count_free = (F.when(F.col("consistent"), F.col(a)).otherwise(F.col(b)) for a, b in (("fit", "all"), ("fit_free", "all_free")))
    by_free = count_free * F.col("n") > count * F.col("n_free")
    got = got.select("doc_id", "item_id", F.when(by_free, count_free).otherwise(count).alias("windows"), F.when(by_free, F.col("n_free")).otherwise(F.col("n")).cast("long").alias("item_windows"), "slots", "consistent")
    got = got.select("doc_id", "item_id", "windows", "item_windows", (F.col("windows") / F.col("item_windows")).alias("coverage"), "slots", "consistent")
    return got.withColumn("contaminated", F.col("consistent") & (F.col("coverage") >= min_coverage))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """``docs`` without the rows whose document is contaminated; rows with a null id stay."""
    leaks = cut(benchmark_matches(docs, benchmark, id_col=id_col, **options).where("contaminated").select(F.col("doc_id").alias(id_col)).distinct())
    return semi_by_key(docs, leaks, id_col, how="left_anti")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contaminated documents, a row for each item found in them."""
    found = benchmark_matches(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where("contaminated")
