"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters.

Steps, none of which emits the pairs of a group:

1. Each document becomes a set of shingle hashes; documents with the same set are one class.
2. A count sketch of fixed size over the shingles of all documents gives the order, rare first. Shingles
   that share a counter share a rank and go on by hash, so the order is total and the filters stay exact.
3. Sets that differ in d shingles and link hold at least 3d in common, so in that order two of these follow
   each other with none of the d between: a pair of neighbours that both sets have. Long texts meet in single
   shingles by chance, ever more of them as the corpus grows, but hardly in such pairs. (Thresholds under 3/4
   do not give such pairs, and go by single shingles.)
4. Each pair of a prefix says which set sizes a partner may have if this is the first pair both hold (length
   and positional filter). Two sets can only link if these ranges meet, so the sets with a common prefix pair
   split into runs of meeting ranges. Tasks reduce their postings to such runs before the shuffle, and runs
   are reduced once more after it: a pair of a hot group costs a posting a task. Postings are shuffled packed.
5. Runs give candidate groups. Their sets are compared once per pair, in blocks of bounded size, with the
   suffix filter ahead of the exact count; only a spanning forest of the links and link counts leave a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.llm.cluster import cut, free_shuffles, join_groups, semi_by_key, width
from quarrymill.llm.components import connected_components
from quarrymill.llm.exact_dedup import LOWER, UPPER
from quarrymill.llm.words import Words, mix, signed, slices

#: log2 of the counters of the sketch: 4 MB however large the corpus.
SKETCH_BITS = 20
_SLICE = 1 << 14
#: Postings that a task gathers before it reduces them.
_GATHER = 1 << 20
#: Bits of a pair's hash and of a class's name in a posting; what coincides so only makes candidates.
_TOKEN, _CLASS = 40, 48
#: Shingles of the sets whose postings (about half as many) are dealt to one bucket.
_BUCKET = 2_000_000
#: Shingles that a block of a candidate group holds about.
BLOCK_SHINGLES = 400_000


def _sets(part: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of each text that has words."""
    h, b = Words(data, offsets).shingles(k)
    for i in range(len(b) - 1):
        if b[i + 1] > b[i]:
            s = np.sort(h[b[i] : b[i + 1]])
            yield i, s[np.concatenate(([True], s[1:] != s[:-1]))]


def class_of(s: np.ndarray) -> int:
    """64-bit name of a set."""
    total = (int(mix(s).sum(dtype=np.uint64)) + len(s) * 0x9E3779B97F4A7C15) % (1 << 64)
    return int(mix(np.array([total], np.uint64)).view(np.int64)[0])


def _profile(docs: DataFrame, k: int, bits: int) -> DataFrame:
    """Rows of documents (kind 0: doc_id, key, n, class) and slices of the sketch (kind 1: slice, counters)."""
    size = 1 << bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros(size, np.uint32)
        for batch in batches:
            for part, data, offsets in slices(batch, "text"):
                n, cls = np.zeros(len(part), np.int64), np.zeros(len(part), np.int64)
                some = []
                for i, s in _sets(part, data, offsets, k):
                    n[i], cls[i] = len(s), class_of(s)
                    some.append(s)
                if some:
                    at, c = np.unique(np.concatenate(some) >> np.uint64(64 - bits), return_counts=True)
                    counters[at.astype(np.int64)] += c.astype(np.uint32)
                m = len(part)
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(m, np.int32)), part.column("doc_id"), part.column("key"), pa.array(n), pa.array(cls), pa.nulls(m, pa.binary())], ["kind", "doc_id", "key", "n", "class", "counters"])
        step = min(_SLICE, size)
        for i in range(0, size, step):
            if (c := counters[i : i + step]).any():
                c = c.astype(np.min_scalar_type(c.max()))
                yield pa.RecordBatch.from_arrays([pa.array([1], pa.int32()), pa.array([None], pa.int64()), pa.array([0], pa.int64()), pa.array([i], pa.int64()), pa.array([0], pa.int64()), pa.array([c.tobytes()], pa.binary())], ["kind", "doc_id", "key", "n", "class", "counters"])

    return docs.mapInArrow(run, "kind int, doc_id long, key long, n long, class long, counters binary")


def _sketch(profile: DataFrame, bits: int) -> np.ndarray:
    """The counters of all tasks summed; what reaches the driver is 4 MB at 20 bits."""

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(min(_SLICE, 1 << bits), np.int64)
        for c in table.column("counters"):
            total += np.frombuffer(c.as_buffer(), f"u{len(c.as_buffer()) // len(total)}")  # as narrow as its task could
        top = np.minimum(total, np.iinfo(np.uint32).max).astype(np.uint32)
        return pa.table({"n": table.column("n").slice(0, 1), "counters": pa.array([top.tobytes()], pa.binary())})

    # two levels, so that no task reads the slices of all tasks
    rows = profile.where("kind = 1").select("n", "counters", F.spark_partition_id().alias("p"))
    once = rows.groupBy("n", (F.col("p") % 64).alias("q")).applyInArrow(add, "n long, counters binary")
    out = np.zeros(1 << bits, np.uint32)
    for r in once.groupBy("n").applyInArrow(add, "n long, counters binary").toArrow().to_pylist():
        c = np.frombuffer(r["counters"], np.uint32)
        out[r["n"] : r["n"] + len(c)] = c
    return out


def _runs(token: np.ndarray, low: np.ndarray, high: np.ndarray, cls: np.ndarray):
    """Runs of meeting ranges of each token: (token, low, high, a class) and the edges that tie each run together."""
    order = np.lexsort((low, token))
    token, low, high, cls = token[order], low[order].astype(np.int64), high[order].astype(np.int64), cls[order]
    n = len(token)
    new = np.ones(n, bool)
    new[1:] = token[1:] != token[:-1]
    group = np.cumsum(new)
    reach = np.maximum.accumulate(group * np.int64(1 << 40) + high)
    start = new.copy()
    start[1:] |= low[1:] > (reach[:-1] - group[:-1] * np.int64(1 << 40))
    at = np.flatnonzero(start)
    ends = np.append(at[1:], n) - 1
    tied = np.flatnonzero(~start)
    u, v = cls[tied], cls[tied - 1]
    return (token[at], low[at], reach[ends] - group[ends] * np.int64(1 << 40), cls[at]), (u, v)


def _distinct_edges(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    a, b = np.minimum(u, v), np.maximum(u, v)
    keep = a != b
    a, b = a[keep], b[keep]
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    if len(a):
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        a, b = a[new], b[new]
    return a, b


def _size_code(x: np.ndarray) -> np.ndarray:
    """Sizes in 12 bits, in the same order; those from 256 on in steps of under 1 %."""
    return ((np.maximum(x, 1).astype(np.float32).view(np.int32) >> 16) - (127 << 7)).astype(np.uint16)


def _packed(token: np.ndarray, low: np.ndarray, high: np.ndarray, cls: np.ndarray) -> bytes:
    """Postings in 14 bytes each: 40 bits of token, 12 of each size, 48 of class."""
    sizes = (low.astype(np.uint64) << np.uint64(12)) | high.astype(np.uint64)
    first = (token.astype(np.uint64) << np.uint64(24)) | sizes
    name = cls.astype(np.uint64)
    return first.tobytes() + (name >> np.uint64(16)).astype(np.uint32).tobytes() + name.astype(np.uint16).tobytes()


def _unpacked(blob: pa.Buffer) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n = len(blob) // 14
    first = np.frombuffer(blob, np.int64, n).view(np.uint64)
    name = (np.frombuffer(blob, np.uint32, n, 8 * n).astype(np.int64) << 16) | np.frombuffer(blob, np.uint16, n, 12 * n)
    low, high = ((first >> np.uint64(k)).astype(np.int64) & 4095 for k in (12, 0))
    return (first >> np.uint64(24)).astype(np.int64), low, high, name


def _name(cls):
    """The bits of a class that postings hold."""
    return F.shiftrightunsigned(cls, 64 - _CLASS)


def by_pairs(num: int, den: int) -> bool:
    """Whether sets that link and differ always have neighbours in common."""
    return num >= 3 * (den - num)


def _prefix(s: np.ndarray, rank: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of the prefix of a set, rarest first, and the largest partner each allows as the first common one.

    For single shingles, J >= num/den needs an overlap of num * (n + m) / (num + den), m the partner's size. For pairs:
    before the first common pair each common shingle is followed by one that only one set has, so at place i there
    are at most D + (n - overlap) shingles of this set before it, D = n + m - 2 * overlap.
    """
    n = len(s)
    least = (num * n + den - 1) // den
    if by_pairs(num, den):
        most = min(n - 1, max(0, (n * (2 * den - num) - least * (2 * num - den)) // (num + den) + 1))
        if most <= 0:
            return s[:0], np.zeros(0, np.int64)
        order = np.argsort(rank, kind="stable")[: most + 1]
        token = s[order[:-1]] + s[order[1:]] * np.uint64(0xD1342543DE82EF95)
        high = (n * (2 * den - num) - np.arange(most, dtype=np.int64) * (num + den)) // (2 * num - den)
        high = np.minimum(high, n * den // num)
    else:
        most = n - least + 1
        token = s[np.argsort(rank, kind="stable")[:most]]
        high = (num + den) * (n - np.arange(len(token), dtype=np.int64)) // num - n
    ok = high >= least
    return token[ok], high[ok]


def _postings(docs: DataFrame, k: int, ranks, bits: int, num: int, den: int, buckets: int) -> DataFrame:
    """By bucket, packed: runs of prefix tokens (runs), and pairs of class names that a task tied already (edges)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = ranks.value
        held: list[tuple[np.ndarray, ...]] = []
        size, seen = 0, set()

        def flush():
            token, low, high, cls = (np.concatenate(c) for c in zip(*held, strict=True))
            held.clear()
            token = mix(token)
            bucket = ((token & np.uint64(0xFFFFFF)) * np.uint64(buckets)) >> np.uint64(24)
            key = ((bucket << np.uint64(_TOKEN)) | (token >> np.uint64(64 - _TOKEN))).astype(np.int64)
            (key, low, high, cls), (u, v) = _runs(key, low, high, cls)
            u, v = _distinct_edges(u, v)
            at = key >> _TOKEN
            tied = (u % buckets).astype(np.int64)
            order = np.argsort(tied, kind="stable")
            tied, ends = tied[order], np.stack([u, v], 1)[order]
            some = np.union1d(at, tied)
            bounds = [np.append(np.searchsorted(x, some), len(x)) for x in (at, tied)]
            for j in range(0, len(some), 64):
                runs, edges = [], []
                for i in range(j, min(j + 64, len(some))):
                    a, b = bounds[0][i : i + 2]
                    runs.append(_packed(key[a:b] & ((1 << _TOKEN) - 1), low[a:b], high[a:b], cls[a:b]))
                    edges.append(ends[slice(*bounds[1][i : i + 2])].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(some[j : j + 64], pa.int32()), pa.array(runs, pa.binary()), pa.array(edges, pa.binary())], ["bucket", "runs", "edges"])

        for batch in batches:
            for part, data, offsets in slices(batch, "text"):
                for _, s in _sets(part, data, offsets, k):
                    cls = class_of(s)
                    if cls in seen:
                        continue
                    seen.add(cls)
                    if len(seen) > 1_000_000:
                        seen.clear()
                    token, high = _prefix(s, count[(s >> np.uint64(64 - bits)).astype(np.int64)], num, den)
                    # sizes n and m may pair where n is within the partner's reach and m within this one's; a
                    # reach below n leaves the partners whose range holds it, so the range is that one point
                    if len(token):
                        held.append((token, _size_code(np.minimum(len(s), high)), _size_code(high), np.full(len(token), (cls % (1 << 64)) >> (64 - _CLASS), np.int64)))
                        size += len(token)
                    if size >= _GATHER:
                        yield from flush()
                        size = 0
        if held:
            yield from flush()

    return docs.mapInArrow(run, "bucket int, runs binary, edges binary")


def _edges_of_tokens(found: DataFrame) -> DataFrame:
    """Edges that tie the runs of each token together, and those that tasks found before."""

    def run(table: pa.Table) -> pa.Table:
        cols = [np.concatenate(c) for c in zip(*(_unpacked(b.as_buffer()) for b in table.column("runs")), strict=True)]
        early = np.concatenate([np.frombuffer(b.as_buffer(), np.int64) for b in table.column("edges")]).reshape(-1, 2)
        u, v = _runs(*cols)[1] if len(cols[0]) else (np.zeros(0, np.int64),) * 2
        u, v = _distinct_edges(np.concatenate([u, early[:, 0]]), np.concatenate([v, early[:, 1]]))
        return pa.table({"u": u, "v": v})

    return found.groupBy("bucket").applyInArrow(run, "u long, v long")


def _link(sets: list[np.ndarray], left: int, num: int, den: int, same: bool):
    """Links among sets: of the first ``left`` with the others, or of all of them when ``same``.

    Yields (i, array of j > i). Sizes and the suffix filter (a bitmap bound on the overlap) come first, then
    shingles are counted through an index of the block.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets)
    _, ids = np.unique(flat, return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(ids, kind="stable")
    by, heads = owner[order], np.searchsorted(ids[order], np.arange(ids.max() + 2))
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    parity = np.zeros((len(sets), 16), np.uint64)
    np.bitwise_xor.at(parity, (owner, ((flat >> np.uint64(6)) & np.uint64(15)).astype(int)), np.uint64(1) << (flat & np.uint64(63)))
    for i in range(left if not same else len(sets)):
        js = np.arange(i + 1 if same else left, len(sets))
        n, m = sizes[i], sizes[js]
        js = js[(num * np.maximum(n, m) <= den * np.minimum(n, m))]
        if len(js):
            apart = np.bitwise_count(parity[js] ^ parity[i]).sum(1)
            js = js[(num + den) * apart.astype(np.int64) <= (den - num) * (n + sizes[js])]
        if not len(js):
            continue
        mine = ids[bounds[i] : bounds[i + 1]]
        a, e = heads[mine], heads[mine + 1]
        total = int((e - a).sum())
        at = np.repeat(a - np.concatenate([[0], np.cumsum(e - a)[:-1]]), e - a) + np.arange(total)
        both = np.bincount(by[at], minlength=len(sets))[js]
        js = js[den * both >= num * (n + sizes[js] - both)]
        if len(js):
            yield i, js


def _verify(blocks: DataFrame, num: int, den: int) -> DataFrame:
    """Links of each block pair: a spanning forest (kind 0: u, v) and how many links each class has (kind 1: u, count)."""

    def run(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        cls = table.column("class").to_numpy()
        order = np.lexsort((cls, side))
        blobs = table.column("set")
        sets = [np.frombuffer(blobs[int(i)].as_buffer(), np.uint64) for i in order]
        cls, side = cls[order], side[order]
        left = int((side == 0).sum())
        same = left == len(cls)
        root = np.arange(len(cls))
        links = np.zeros(len(cls), np.int64)

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return int(i)

        u, v = [], []
        for i, js in _link(sets, left, num, den, same):
            links[i] += len(js)
            links[js] += 1
            for j in js:
                a, b = find(i), find(int(j))
                if a != b:
                    root[b] = a
                    u.append(cls[i])
                    v.append(cls[j])
        some = np.flatnonzero(links)
        return pa.table({"kind": pa.array([0] * len(u) + [1] * len(some), pa.int32()), "u": pa.array(np.concatenate([np.array(u, np.int64), cls[some]])), "v": pa.array(np.concatenate([np.array(v, np.int64), links[some]]))})

    return blocks.groupBy("comp", "bi", "bj").applyInArrow(run, "kind int, u long, v long")


def _set_rows(docs: DataFrame, k: int) -> DataFrame:
    """comp, m, class, set of the rows whose text is of the class that they name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in slices(batch, "text"):
                at, cls, blob = [], [], []
                named = part.column("class").to_numpy()
                for i, s in _sets(part, data, offsets, k):
                    if class_of(s) == named[i]:
                        at.append(i)
                        cls.append(named[i])
                        blob.append(s.tobytes())
                if at:
                    yield pa.RecordBatch.from_arrays([part.column("comp").take(pa.array(at)), part.column("m").take(pa.array(at)), pa.array(cls, pa.int64()), pa.array(blob, pa.binary())], ["comp", "m", "class", "set"])

    return docs.mapInArrow(run, "comp long, m long, class long, set binary")


def _row_key(id_col: str, text_col: str):
    """Rows are found again by a hash of id and text, as ids may be null or repeat."""
    return F.xxhash64(F.col(id_col).cast("long"), F.col(text_col).cast("string"))


def ngram_jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, threshold: tuple[int, int] = (3, 4)) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links for every row of ``docs``.

    Two documents link when the Jaccard similarity of their sets of ``k``-word shingles is at least
    ``threshold`` (numerator, denominator). ``component_id`` is the smallest id reachable over links;
    ``n_links`` counts the links of the document's set to other sets. Shingles are compared by 64-bit hash.

    Null and empty texts, and texts of white space, have no shingle, link with nothing and are components
    of their own. Rows that repeat an id give a row each, with the links of their own text. Rows with a null id
    keep it and never name a component, but link others; components of such rows alone have a null name. An empty table gives an empty result. Only the two named columns are read.
    """
    return _joined(docs, id_col, text_col, k, threshold).select("doc_id", "n_shingles", "component_id", "n_links")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, threshold: tuple[int, int] = (3, 4)) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest id, ids that are null last; all columns as they are.

    Of rows that repeat an id, one stays if their texts link, and one of those that repeat the text as well. Rows
    without a word are no copies of each other and all stay. An empty table gives an empty result.
    """
    found = _joined(docs, id_col, text_col, k, threshold)
    gone = cut(found.where(~F.col("kept")).select(F.col("key").alias("_row_key")).distinct())
    rows = docs.withColumn("_row_key", _row_key(id_col, text_col))
    rows = semi_by_key(rows, gone, "_row_key", how="left_anti")
    again = cut(found.where(F.col("kept") & (F.col("n_shingles") > 0)).groupBy("key").agg(F.count(F.lit(1)).alias("_k")).where("_k > 1").select(F.col("key").alias("_row_key")))
    n = again.count()
    if n:
        once = semi_by_key(rows, again, "_row_key", n, how="left_anti")
        rows = once.unionByName(semi_by_key(rows, again, "_row_key", n).dropDuplicates(["_row_key"]).select(*once.columns))
    return rows.select(*docs.columns)


def _joined(docs: DataFrame, id_col: str, text_col: str, k: int, threshold: tuple[int, int]) -> DataFrame:
    """The columns of ``ngram_jaccard_join``, key of the row, and kept: it stands for its component, or has no shingle."""
    num, den = threshold
    spark = docs.sparkSession
    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("key", _row_key("doc_id", "text"))
    profile = cut(_profile(read, k, SKETCH_BITS))
    ids = profile.where("kind = 0").select("doc_id", "key", "n", "class")
    total = ids.count()
    ranks = spark.sparkContext.broadcast(_sketch(profile, SKETCH_BITS))
    least_row = F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "key")).alias("r")
    classes = ids.where("n > 0").groupBy("class").agg(least_row, F.count(F.lit(1)).alias("rows"), F.first("n").alias("n"))
    classes = cut(classes.select("class", F.col("r.doc_id").alias("rep"), F.col("r.key").alias("key"), "rows", "n"))

    # about half of the shingles start a posting; a task gets 4 million of them, in four buckets
    shingles = ids.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    parts = max(width(spark), -(-shingles // (4 * _BUCKET)))
    near = _edges_of_tokens(_postings(read, k, ranks, SKETCH_BITS, num, den, 4 * parts).repartition(parts, "bucket"))
    groups = cut(connected_components(near).withColumnRenamed("node", "name").withColumnRenamed("label", "comp"))
    del near
    free_shuffles(spark)  # the postings, before the blocks are dealt

    member = classes.withColumn("name", _name("class")).join(groups.hint("merge"), "name").drop("name")
    mass = member.groupBy("comp").agg(F.sum("n").alias("m"))
    chosen = cut(join_groups(member.select("key", "class", "comp"), mass.withColumn("_size", F.col("m")), "comp", "_size", total).select("key", "class", "comp", "m"))
    source = semi_by_key(read, chosen, "key", how="inner")
    # a class is read from one row; only rows that repeat an id and its text have more, and only they are shuffled to drop the rest
    again = cut(semi_by_key(ids, chosen.select("key"), "key").groupBy("key").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("key"))
    n_again = again.count()
    if n_again:
        source = semi_by_key(source, again, "key", n_again, how="left_anti").unionByName(semi_by_key(source, again, "key", n_again).dropDuplicates(["key"]))
    sets = _set_rows(source.select("text", "comp", "m", "class"), k)
    blocked = sets.withColumn("nb", F.ceil(F.col("m") / BLOCK_SHINGLES)).withColumn("b", F.pmod(F.xxhash64("class"), "nb"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1)).alias("o")
    pairs = blocked.select("comp", "class", "set", "b", other).select(
        "comp", "class", "set", F.least("b", "o").alias("bi"), F.greatest("b", "o").alias("bj"), F.when(F.col("b") <= F.col("o"), 0).otherwise(1).alias("side")
    )
    links = cut(_verify(pairs, num, den))
    free_shuffles(spark)
    forest = links.where("kind = 0").select("u", "v")
    counted = links.where("kind = 1").groupBy(F.col("u").alias("class")).agg(F.sum("v").alias("n_links"))
    comps = connected_components(forest).withColumnRenamed("node", "class").withColumnRenamed("label", "root")
    named = comps.join(classes.select("class", "rep", "key").hint("merge"), "class")
    first = F.min(F.struct(F.isnull("rep").alias("none"), "rep", "key"))
    least = named.groupBy("root").agg(first.alias("least"), F.count(F.lit(1)).alias("_n"))
    linked = join_groups(named.drop("rep", "key"), least, "root", "_n", total).select("class", "least").join(counted.hint("merge"), "class", "left")
    answer = classes.join(linked.hint("merge"), "class", "left")
    answer = answer.select("class", "rows", F.coalesce("least.rep", "rep").alias("component_id"), F.coalesce("least.key", "key").alias("keep"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    full = join_groups(ids, answer, "class", "rows", total)
    return full.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        "key",
        ((F.col("n") == 0) | (F.col("key") == F.col("keep"))).alias("kept"),
    )


#: By brute force over all shingles; components by recursion.
ORACLE_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM d),
n AS (SELECT doc_id, len(s) AS n, md5(array_to_string(list_sort(s), chr(10))) AS class FROM s),
t AS (SELECT doc_id, unnest(s) AS g FROM s),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM t a JOIN t b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y, b.class <> a.class AS other, b.class FROM c JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
r AS (SELECT doc_id, doc_id AS near FROM n UNION SELECT r.doc_id, l.y FROM r JOIN l ON l.x = r.near),
m AS (SELECT doc_id, min(near) AS component_id FROM r GROUP BY 1),
k AS (SELECT x AS doc_id, count(DISTINCT class) FILTER (other) AS n_links FROM l GROUP BY 1)
SELECT n.doc_id, n.n AS n_shingles, m.component_id, coalesce(k.n_links, 0) AS n_links FROM n JOIN m USING (doc_id) LEFT JOIN k USING (doc_id)
"""


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet"))
