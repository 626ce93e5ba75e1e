"""Line dedup as an exact set-similarity join over the lines of all documents.

A line is the set of its words. Words are ordered by rarity, and two lines whose Jaccard similarity reaches the
threshold have a word of their prefixes in common, at places that still allow the overlap. A line goes if an earlier
line (by document id, then place) matches it.

1. Equal lines are settled by a 128-bit hash; only the first of them goes on.
2. A sketch of fixed size counts the words of all lines. It gives the order, and it bounds from above how many lines
   hold a word: words of one line are left out, and the others are light (``LIGHT`` lines or fewer) or heavy.
3. Copies of a line are settled before any pairs are made: a line meets the earliest line of each of its heavy words,
   and the first and the last one before it among the lines that share the least or the largest hash of its light
   prefix words. So groups of near copies do not yield their pairs.
4. Lines that find no match so are compared with all earlier lines of their prefix words. Light words are joined as they
   are: one shuffle, read by both sides, with the length, positional and parity filters inside the join; settled lines
   carry a mark there and yield no pairs, while others still meet them. By heavy words they first meet one in ``SHARE``
   of all lines; a line of many partners is settled there by one of them, and only the others meet the rest.
5. Candidates are verified on the words themselves: the likeliest partner of each line first, the others for those
   lines alone that it did not settle.

Native: DataFrame functions only.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrymill.llm.cluster import BROADCAST_ROWS, cut, join_groups, written
from quarrymill.llm.exact_dedup import LOWER, UPPER, fold_ascii

#: Lines of fewer characters are left alone by default; the query and the pipeline let every line with a word take part.
MIN_CHARS, EVERY_LINE = 30, 1
#: Counters of the rarity sketch, one byte each: a fixed size, whatever the corpus.
SKETCH = 1 << 20
_SLICE = 1 << 10
#: Lines that a light word has at most (the largest count of its rank).
LIGHT = 1448
#: One line in so many, by a hash, that lines with heavy words are compared with before the rest.
SHARE = 16
#: Lines of so many words carry a parity map of 128 bits instead of 64.
LONG = 64
#: Keys of two longs that may be broadcast, some 50 MB; rows that one line text may be joined with in one task.
_KEYS, _HOT = 2 * BROADCAST_ROWS, 50_000
NUM, DEN = 3, 4
#: Bits that a word's place takes beside the line's words, and that a row of a repeated id has for its tag.
_POS, _TAG = 24, 37
#: Stands above the words of a settled line; no line is so long that it reaches there.
_SETTLED = 1 << 38


def _rank(count: Column) -> Column:
    return F.least(F.lit(126), F.floor(2 * F.log2(count + 1))).cast("int")


_ONCE, _LIGHT = 2, math.floor(2 * math.log2(LIGHT + 1))


def _tagged(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, bool]:
    """``docs`` with _line_tag: 0, and for rows of repeated ids a hash of the text that tells them apart; and whether there are such rows."""
    ids = cut(docs.groupBy(F.col(id_col).cast("long").alias("_line_id")).agg(F.count(F.lit(1)).alias("_line_k")).where("_line_k > 1 and _line_id is not null").select("_line_id"))
    n = ids.count()
    if not n:
        return docs.withColumn("_line_tag", F.lit(0).cast("long")), False
    marked = docs.join(F.broadcast(ids) if n <= BROADCAST_ROWS else ids.hint("merge"), F.col(id_col).cast("long") == F.col("_line_id"), "left")
    tag = F.shiftrightunsigned(F.xxhash64(F.col(text_col).cast("string")), 64 - _TAG)
    return marked.withColumn("_line_tag", F.when(F.col("_line_id").isNull(), F.lit(0).cast("long")).otherwise(tag)).drop("_line_id"), True


def _folded(text: Column) -> Column:
    """A-Z folded, white space but line feeds as blanks."""
    text = fold_ascii(text)
    for c in "\t\x0b\f\r":
        text = F.replace(text, F.lit(c), F.lit(" "))
    return text


def _lines(rows: DataFrame, min_chars: int) -> DataFrame:
    """doc_id, at, raw (as it stands in the text) of each line that is long enough and holds a word.

    ``at`` is the line number; in rows of a repeated id the tag stands above it.
    """
    rows = rows.select("doc_id", "tag", F.posexplode(F.split("text", "\n")).alias("i", "raw"))
    at = F.shiftleft("tag", 63 - _TAG) + F.col("i")
    return rows.where((F.length("raw") >= min_chars) & (F.trim("raw", F.lit(" \t\x0b\f\r")) != "")).select("doc_id", at.alias("at"), "raw")


def _line() -> Column:
    return _folded(F.col("raw")).alias("line")  # what folds is only what is left of the lines where this is selected


def _words(line: Column) -> Column:
    return F.array_remove(F.split(line, " "), "")  # a split at one literal sign is the fast one


def _later_copies(lines: DataFrame) -> tuple[DataFrame, Callable[[], None]]:
    """(doc_id, at) of lines that equal an earlier one."""
    keyed = lines.select("doc_id", "at", _line()).select("doc_id", "at", F.xxhash64("line").alias("s"), F.xxhash64(F.lit(1), "line").alias("t"))
    firsts = keyed.groupBy("s", "t").agg(F.min(F.struct("doc_id", "at")).alias("f")).select("f.*")
    return written(lines.select("doc_id", "at").join(firsts.hint("merge"), ["doc_id", "at"], "left_anti").distinct())


def _sketch(rows: DataFrame) -> DataFrame:
    """One row: the rank of each counter, twice the log2 of its words in all texts, as an array of bytes."""
    words = rows.select(F.explode(F.split(F.replace(_folded(F.col("text")), F.lit("\n"), F.lit(" ")), " ")).alias("t"))
    counts = words.select(F.xxhash64("t").bitwiseAND(F.lit(SKETCH - 1)).cast("int").alias("k")).groupBy("k").count()
    every = rows.sparkSession.range(SKETCH).select(F.col("id").cast("int").alias("k"), F.lit(0).cast("long").alias("count"))
    dense = counts.unionByName(every).groupBy("k").agg(_rank(F.max("count")).cast("tinyint").alias("r"))
    parts = dense.groupBy(F.shiftright("k", int(math.log2(_SLICE))).alias("s")).agg(F.sort_array(F.collect_list(F.struct("k", "r")))["r"].alias("r"))
    return cut(parts.groupBy().agg(F.flatten(F.sort_array(F.collect_list(F.struct("s", "r")))["r"]).alias("ranks")))


def _parity(words: Column, high: bool = False) -> Column:
    def bit(x: Column) -> Column:
        one = F.call_function("shiftleft", F.lit(1).cast("long"), x.bitwiseAND(F.lit(63)).cast("int"))
        return F.when(x.bitwiseAND(F.lit(64)) == 0, F.lit(0).cast("long")).otherwise(one) if high else one

    return F.aggregate(words, F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(bit(x)))


def _sets(lines: DataFrame, sketch: DataFrame, num: int, den: int) -> DataFrame:
    """doc_id, at, n (number of words), par, hi (parity maps) and prefix: words as longs, 7 bits of rank and 56 of hash, the rarest first."""

    def word(h: Column) -> Column:
        rank = F.get(F.col("ranks"), h.bitwiseAND(F.lit(SKETCH - 1)).cast("int")).cast("long")
        return F.coalesce(F.shiftleft(rank, 56).bitwiseOR(F.shiftrightunsigned(h, 8)), F.lit(0).cast("long"))  # never null, and so sorted as plain longs

    none = F.xxhash64(F.lit(""))  # what stands between two blanks
    hashed = F.array_remove(F.array_distinct(F.transform(F.split("line", " "), lambda t: F.xxhash64(t))), none)
    ranked = lines.select("doc_id", "at", _line()).select("doc_id", "at", hashed.alias("h"), sketch.scalar().alias("ranks"))
    sets = ranked.select("doc_id", "at", F.sort_array(F.transform("h", word)).alias("w"))
    n = F.size("w")
    hi = F.when(n >= LONG, _parity(F.col("w"), True)).otherwise(F.lit(0).cast("long"))
    prefix = n - F.ceil(n * num / den).cast("int") + 1
    return sets.select("doc_id", "at", n.alias("n"), _parity(F.col("w")).alias("par"), hi.alias("hi"), F.slice("w", F.lit(1), prefix).alias("prefix"))


def _postings(sets: DataFrame, low: int, high: int) -> DataFrame:
    """word, doc_id, at, np (words of the line and the word's place), par, hi for prefix words of a rank over ``low``, up to ``high``."""
    rows = sets.select("doc_id", "at", "n", "par", "hi", F.posexplode("prefix").alias("pos", "word"))
    rank = F.shiftrightunsigned("word", 56)
    return rows.where((rank > low) & (rank <= high)).select("word", "doc_id", "at", (F.shiftleft(F.col("n").cast("long"), _POS) + F.col("pos")).alias("np"), "par", "hi")


def _filters(a, b, num: int, den: int) -> tuple[Column, Column]:
    """Whether line ``b`` is earlier than ``a`` and the length, positional and parity filters let the two through; and their distance in the parity maps.

    The mark of a settled line makes it too long to match as ``a``, and is taken off as ``b``.
    """
    n, m = F.shiftrightunsigned(a("np"), _POS), F.shiftrightunsigned(b("np"), _POS).bitwiseAND(F.lit(_SETTLED - 1))
    i, j = (s("np").bitwiseAND(F.lit((1 << _POS) - 1)) for s in (a, b))
    differ = lambda f: F.bit_count(f(a).bitwiseXOR(f(b)))
    apart = F.when(F.least(n, m) >= LONG, differ(lambda s: s("hi")) + differ(lambda s: s("par").bitwiseXOR(s("hi")))).otherwise(differ(lambda s: s("par")))
    earlier = (b("doc_id") < a("doc_id")) | ((b("doc_id") == a("doc_id")) & (b("at") < a("at")))
    sizes = (F.lit(num) * F.greatest(n, m) <= F.lit(den) * F.least(n, m)) & (F.lit(num + den) * F.least(n - i, m - j) >= F.lit(num) * (n + m))
    return earlier & sizes & (F.lit(num + den) * apart <= F.lit(den - num) * (n + m)), apart / (n + m)


def _pairs(later: DataFrame, earlier: DataFrame, num: int, den: int) -> DataFrame:
    """doc_id, at, d2, a2, apart of lines that share a word and pass the filters, which the join itself applies."""
    on, apart = _filters(lambda c: F.col(f"a.{c}"), lambda c: F.col(f"b.{c}"), num, den)
    on = on & (F.col("a.word") == F.col("b.word"))
    return later.alias("a").join(earlier.alias("b").hint("merge"), on).select("a.doc_id", "a.at", F.col("b.doc_id").alias("d2"), F.col("b.at").alias("a2"), apart.alias("apart"))


def _head_pairs(met: DataFrame, num: int, den: int) -> DataFrame:
    """The same for lines with one earlier line each, ``c``."""
    passed, apart = _filters(F.col, lambda c: F.col(f"c.{c}"), num, den)
    return met.where(passed).select("doc_id", "at", F.col("c.doc_id").alias("d2"), F.col("c.at").alias("a2"), apart.alias("apart"))


def _near_copies(sets: DataFrame) -> DataFrame:
    """Lines with an earlier one, ``c``: the first, and the last before it, that share the least or the largest hash of its light prefix words."""
    rank = lambda w: F.shiftrightunsigned(w, 56)
    hashes = F.transform("prefix", lambda w: F.when((rank(w) > _ONCE) & (rank(w) <= _LIGHT), F.shiftleft(w, 8)))
    line = ["doc_id", "at", F.shiftleft(F.col("n").cast("long"), _POS).alias("np"), "par", "hi"]
    keyed = sets.select(*line, hashes.alias("h")).select("doc_id", "at", "np", "par", "hi", F.explode(F.array_distinct(F.array(F.array_min("h"), F.array_max("h")))).alias("key"))
    order = Window.partitionBy("key").orderBy("doc_id", "at")
    one = F.struct("doc_id", "at", "np", "par", "hi")
    met = keyed.where("key is not null").select("*", F.first(one).over(order).alias("first"), F.lag(one).over(order).alias("last"))
    return met.where("last is not null").select("doc_id", "at", "np", "par", "hi", F.explode(F.array_distinct(F.array("first", "last"))).alias("c"))


def _settled(sets: DataFrame, found: DataFrame, n: int) -> DataFrame:
    """``sets`` with ``n`` marked for the lines in ``found``."""
    there = found.select("doc_id", "at", F.lit(_SETTLED).alias("mark"))
    marked = sets.join(F.broadcast(there) if n <= _KEYS else there.hint("merge"), ["doc_id", "at"], "left")
    return marked.withColumn("n", F.col("n") + F.coalesce("mark", F.lit(0))).drop("mark")


def _without(rows: DataFrame, gone: DataFrame, n: int) -> DataFrame:
    return rows.join(F.broadcast(gone) if n <= _KEYS else gone.hint("merge"), ["doc_id", "at"], "left_anti")


def _texts(rows: DataFrame, pairs: DataFrame, min_chars: int) -> tuple[DataFrame, Callable[[], None]]:
    """doc_id, at, line of the lines in ``pairs``, as a written table."""
    ids = cut(pairs.select("doc_id", "at").unionByName(pairs.select(F.col("d2").alias("doc_id"), F.col("a2").alias("at"))).distinct())
    if ids.count() > _KEYS:
        return written(_lines(rows, min_chars).join(ids.hint("merge"), ["doc_id", "at"], "left_semi").select("doc_id", "at", _line()))
    some = rows.join(F.broadcast(ids.select("doc_id").distinct()), "doc_id", "left_semi")
    return written(_lines(some, min_chars).join(F.broadcast(ids), ["doc_id", "at"], "left_semi").select("doc_id", "at", _line()))


def _checked(texts: DataFrame, pairs: DataFrame, num: int, den: int) -> DataFrame:
    """(doc_id, at) of the lines of ``pairs`` whose similarity with the other line reaches the threshold, by the words themselves."""
    # the text of a line that very many are compared with is dealt to several tasks
    hot = cut(pairs.groupBy("d2", "a2").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > _HOT).select("d2", "a2", F.ceil(F.col("k") / _HOT).cast("int").alias("copies")))
    pairs = pairs.join(F.broadcast(hot), ["d2", "a2"], "left").withColumn("copies", F.coalesce("copies", F.lit(1)))
    pairs = pairs.select("doc_id", "at", "d2", "a2", F.pmod(F.xxhash64("doc_id", "at"), F.col("copies")).cast("int").alias("copy"))
    other = texts.select(F.col("doc_id").alias("d2"), F.col("at").alias("a2"), F.col("line").alias("line2")).join(F.broadcast(hot), ["d2", "a2"], "left")
    other = other.select("d2", "a2", "line2", F.explode(F.sequence(F.lit(0), F.coalesce("copies", F.lit(1)) - 1)).alias("copy"))
    both = pairs.join(texts.hint("merge"), ["doc_id", "at"]).join(other.hint("merge"), ["d2", "a2", "copy"])
    both = both.select("doc_id", "at", F.array_distinct(_words(F.col("line"))).alias("w"), F.array_distinct(_words(F.col("line2"))).alias("v"))
    both = both.select("doc_id", "at", (F.size("w") + F.size("v")).alias("total"), F.size(F.array_intersect("w", "v")).alias("common"))
    return cut(both.where(F.lit(num + den) * F.col("common") >= F.lit(num) * F.col("total")).select("doc_id", "at").distinct())


def _matched(rows: DataFrame, pairs: DataFrame, num: int, den: int, min_chars: int) -> DataFrame:
    """(doc_id, at) of the lines that match a partner in ``pairs``: the likeliest one is tried first."""
    texts, drop = _texts(rows, pairs, min_chars)
    best = cut(pairs.groupBy("doc_id", "at").agg(F.min(F.struct("apart", "d2", "a2")).alias("b")).select("doc_id", "at", "b.d2", "b.a2"))
    found = _checked(texts, best, num, den)
    others = _without(pairs.drop("apart"), found, found.count()).join(best.hint("merge"), ["doc_id", "at", "d2", "a2"], "left_anti")
    more = _checked(texts, cut(others), num, den)
    drop()
    return found.unionByName(more)


def _gone(tagged: DataFrame, repeats: bool, id_col: str, text_col: str, threshold: tuple[int, int], min_chars: int) -> DataFrame:
    """doc_id, tag, line_no of the lines that go, once each."""
    num, den = threshold
    rows = tagged.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col("_line_tag").alias("tag"), F.col(text_col).cast("string").alias("text"))
    # rows that repeat an id and its text are one document
    rows = rows.where("tag = 0").unionByName(rows.where("tag <> 0").dropDuplicates(["doc_id", "tag"])) if repeats else rows
    gone = _gone_at(rows, num, den, min_chars)
    tag = F.shiftrightunsigned("at", 63 - _TAG)
    return gone.select("doc_id", tag.alias("tag"), (F.col("at") - F.shiftleft(tag, 63 - _TAG)).cast("int").alias("line_no"))


def _gone_at(rows: DataFrame, num: int, den: int, min_chars: int) -> DataFrame:
    """(doc_id, at) of the lines that go."""
    lines = _lines(rows, min_chars)
    copies, drop_copies = _later_copies(lines)
    # a table of its own: what is computed up to here is then the same plan for all who read it, so its shuffle is used again
    sets, drop_sets = written(_sets(_without(lines, copies, copies.count()), _sketch(rows), num, den))
    heavy = _postings(sets, _LIGHT, 127)
    first = F.min(F.struct("doc_id", "at", "np", "par", "hi")).alias("c")
    heads = cut(heavy.groupBy("word").agg(first, F.count(F.lit(1)).alias("k")).where("k > 1").select("word", "k", "c"))
    met = join_groups(heavy, heads, "word", "k", heavy.count()).where("c is not null")
    pairs, drop_pairs = written(_head_pairs(_near_copies(sets), num, den).unionByName(_head_pairs(met, num, den)).distinct())
    found = cut(_matched(rows, pairs, num, den, min_chars))
    drop_pairs()

    # the lines that are left, against all earlier lines
    n = found.count()
    light = _postings(_settled(sets, found, n), _ONCE, _LIGHT)
    left, first_met = _without(heavy, found, n), F.pmod(F.xxhash64("doc_id", "at"), F.lit(SHARE)) == 0
    pairs, drop_pairs = written(_pairs(light, light, num, den).unionByName(_pairs(left, heavy.where(first_met), num, den)).distinct())
    more = cut(_matched(rows, pairs, num, den, min_chars))
    drop_pairs()
    pairs, drop_pairs = written(_pairs(_without(left, more, more.count()), heavy.where(~first_met), num, den).distinct())
    last = _matched(rows, pairs, num, den, min_chars)
    drop_pairs()
    drop_sets()
    gone = cut(copies.unionByName(found).unionByName(more).unionByName(last).distinct())
    drop_copies()
    return gone


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: tuple[int, int] = (NUM, DEN), min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, line_no) of the lines that an earlier line matches.

    Lines are split at line feeds and number from 0. A line matches with Jaccard similarity of its set of words
    (A-Z folded) at least ``threshold``; the earlier line counts whether or not it goes itself. Lines under
    ``min_chars`` characters and blank ones neither go nor match. Null and empty texts have no such lines. Null ids
    are left out. Rows that repeat an id and its text are one document; other rows that repeat an id are documents of
    their own, in the order of a hash of their texts. An empty table gives an empty result. Only the named columns
    are read.
    """
    return _gone(*_tagged(docs.select(id_col, text_col), id_col, text_col), id_col, text_col, threshold, min_chars).select("doc_id", "line_no").distinct()


def _with_gone(docs: DataFrame, id_col: str, text_col: str, threshold: tuple[int, int], min_chars: int) -> DataFrame:
    """``docs`` with _line_gone: the numbers of its lines that go, in order; null where none does."""
    tagged, repeats = _tagged(docs, id_col, text_col)
    gone = _gone(tagged, repeats, id_col, text_col, threshold, min_chars)
    lists = cut(gone.groupBy(F.col("doc_id").alias("_line_id"), F.col("tag").alias("_line_t")).agg(F.sort_array(F.collect_list("line_no")).alias("_line_gone")))
    n, held = lists.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("_line_gone")), F.lit(0))).first()
    on = (F.col(id_col).cast("long") == F.col("_line_id")) & (F.col("_line_tag") == F.col("_line_t"))
    return tagged.join(F.broadcast(lists) if n <= BROADCAST_ROWS and held <= 10 * BROADCAST_ROWS else lists.hint("merge"), on, "left").drop("_line_tag", "_line_id", "_line_t")


def _kept(lines: str) -> Column:
    """The text of the lines that stay, from columns of all lines and of those that go."""
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "_line_gone")
    return F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n")


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: tuple[int, int] = (NUM, DEN), min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with the text of its repeated lines taken out, all other columns as they are.

    A document of which every line goes keeps an empty text. Texts without a repeated line, null ones among them,
    stay as they are, as do rows with a null id. See ``repeated_lines`` for what a repeated line is.
    """
    rows = _with_gone(docs, id_col, text_col, threshold, min_chars).withColumn("_line_all", F.when(F.col("_line_gone").isNotNull(), F.split(F.col(text_col), "\n")))
    text = F.when(F.col("_line_gone").isNull(), F.col(text_col)).otherwise(_kept("_line_all"))
    return rows.select(*[text.alias(c) if c == text_col else F.col(c) for c in docs.columns])


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, lines_removed (their numbers in order, by commas), n_kept_chars, kept_sha256 (of the text that stays) for each document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = _with_gone(docs, "doc_id", "text", (NUM, DEN), EVERY_LINE).withColumn("lines", F.split("text", "\n"))
    left = F.when(F.col("_line_gone").isNull(), F.col("text")).otherwise(_kept("lines"))
    out = rows.select("doc_id", F.size("lines").cast("long").alias("n_lines"), F.coalesce(F.array_join("_line_gone", ","), F.lit("")).alias("lines_removed"), left.alias("t"))
    return out.select("doc_id", "n_lines", "lines_removed", F.length("t").cast("long").alias("n_kept_chars"), F.sha2("t", 256).alias("kept_sha256"))


#: By brute force over all words that two lines share.
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents),
l AS (SELECT doc_id, unnest(range(0, len(x))) AS line_no, unnest(x) AS line FROM d),
w AS (SELECT doc_id, line_no, list_distinct(list_filter(string_split(translate(line, '{UPPER}' || chr(9) || chr(11) || chr(12) || chr(13), '{LOWER}    '), ' '), lambda t: t <> '')) AS s FROM l),
n AS (SELECT doc_id, line_no, s, len(s) AS n, row_number() OVER (ORDER BY doc_id, line_no) AS k FROM w WHERE len(s) > 0),
t AS (SELECT k, n, unnest(s) AS word FROM n),
p AS (SELECT a.k FROM t a JOIN t b ON a.word = b.word AND b.k < a.k AND 3 * greatest(a.n, b.n) <= 4 * least(a.n, b.n) GROUP BY a.k, b.k, a.n, b.n HAVING 7 * count(*) >= 3 * (a.n + b.n)),
g AS (SELECT doc_id, line_no FROM n WHERE k IN (SELECT k FROM p)),
o AS (SELECT l.doc_id, count(*) AS n_lines, string_agg(l.line_no::VARCHAR, ',' ORDER BY l.line_no) FILTER (g.line_no IS NOT NULL) AS gone, string_agg(l.line, chr(10) ORDER BY l.line_no) FILTER (g.line_no IS NULL) AS kept
FROM l LEFT JOIN g ON g.doc_id = l.doc_id AND g.line_no = l.line_no GROUP BY 1)
SELECT doc_id, n_lines, coalesce(gone, '') AS lines_removed, length(coalesce(kept, '')) AS n_kept_chars, sha256(coalesce(kept, '')) AS kept_sha256 FROM o
"""
