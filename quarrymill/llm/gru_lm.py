"""LM scoring with a gated recurrent network: truncated backpropagation in numpy, class-factored softmax.

Counts of all training tokens come from the whole corpus. Their most frequent words form the network's vocabulary,
in classes by frequency; every other token belongs to one more class, in it to the shape of its end, and within that to
its share of the shape's counts (one unseen word in each included). So every token has a probability, whatever it is.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.llm.cluster import cut, held_out, width
from quarrymill.llm.words import Words, mix, signed, slices

CLASSES, PER_CLASS = 64, 64
VOCABULARY = CLASSES * PER_CLASS
HIDDEN = 32
#: Most frequent tokens whose counts are sent to all tasks; the rest are joined.
SHARED = 200_000
#: Tokens that the driver learns the first weights from; then tasks go on with every training text.
WARM_TOKENS, WARM_ROUNDS = 300_000, 3
#: Tokens that a task lays out at a time, and the lanes it deals them to: enough that no long text is left alone in its lane.
TRAIN_TOKENS, TRAIN_LANES = 4_000_000, 128
_SHAPES = 96
_END = np.int64(0x5E4D0F7A11C3B29)
#: Steps of a window, and of one that few lanes are left in.
_WINDOW, _LONGEST = 24, 384
_LN10 = np.log(10.0)


def _shape_table() -> np.ndarray:
    """Shape by a token's last byte: each ASCII sign for itself, then others."""
    table = np.full(256, 47, np.int64)
    for i, c in enumerate(b"abcdefghijklmnopqrstuvwxyz.,!*&#$%|\"'=:;)-?"):
        table[c] = i
    table[48:58] = 44
    table[128:192] = 45
    table[192:] = 46
    return table


_SHAPE = _shape_table()


def tokens_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and shapes of the tokens of a run of texts, ends included, and the range of each text."""
    w = Words(data, offsets)
    h = signed(w.hashes())
    high = np.concatenate([[0], np.cumsum(w.data >= 128)])
    shape = _SHAPE[w.data[w.ends - 1]] + 48 * (high[w.ends] > high[w.starts]) if len(h) else np.zeros(0, np.int64)
    ends = w.bounds[1:]
    n = np.arange(len(ends))
    return np.insert(h, ends, _END), np.insert(shape, ends, 0), np.concatenate([[0], ends + n + 1])


def _count(train: DataFrame) -> DataFrame:
    """(h, shape, c) of all training tokens, summed in each task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush():
            h, s = (np.concatenate(x) for x in zip(*held, strict=True))
            u, first, c = np.unique(h, return_index=True, return_counts=True)
            for i in range(0, len(u), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(u[i : i + 100_000]), pa.array(s[first][i : i + 100_000].astype(np.int32)), pa.array(c[i : i + 100_000])], ["h", "shape", "c"])

        for batch in batches:
            for _, data, offsets in slices(batch, "text"):
                h, s, _ = tokens_of(data, offsets)
                held.append((h, s))
                size += len(h)
                if size > 3_000_000:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    return train.mapInArrow(run, "h long, shape int, c long").groupBy("h").agg(F.first("shape").alias("shape"), F.sum("c").alias("c"))


@dataclass
class Network:
    """Weights: input table, recurrence, class softmax (the last class: tokens outside the vocabulary), softmax within classes, softmax of shapes."""

    seed: int = 11
    p: dict[str, np.ndarray] = field(default_factory=dict)
    #: Tokens of the corpus that tasks trained on, after the first weights.
    seen: int = 0

    def __post_init__(self) -> None:
        if self.p:
            return
        rng = np.random.default_rng(self.seed)
        normal = lambda *s, by=0.1: (rng.standard_normal(s) * by).astype(np.float32)
        self.p = {
            "x": normal(VOCABULARY + _SHAPES, 3 * HIDDEN, by=0.3), "u": normal(HIDDEN, 3 * HIDDEN, by=0.2), "b": np.zeros(HIDDEN, np.float32),
            "wc": normal(HIDDEN, CLASSES + 1), "bc": np.zeros(CLASSES + 1, np.float32),
            "wv": normal(CLASSES, HIDDEN, PER_CLASS), "bv": np.zeros((CLASSES, PER_CLASS), np.float32),
            "ws": normal(HIDDEN, _SHAPES), "bs": np.zeros(_SHAPES, np.float32),
        }

    def start_from(self, counts: np.ndarray, shape_mass: np.ndarray) -> None:
        """Biases that give the relative counts."""
        mass = np.zeros(VOCABULARY)
        mass[: len(counts)] = counts
        by_class = mass.reshape(CLASSES, PER_CLASS)
        self.p["bc"][:] = np.log(np.append(by_class.sum(1), shape_mass.sum()) + 0.5)
        self.p["bc"] -= self.p["bc"].max()
        self.p["bs"][:] = np.log(shape_mass + 0.5)
        self.p["bs"] -= self.p["bs"].max()
        self.p["bv"][:] = np.where(by_class > 0, np.log(by_class + 1e-9), -30.0)
        self.p["bv"] -= self.p["bv"].max(1, keepdims=True)

    def run(self, given: np.ndarray, begin: np.ndarray, live: np.ndarray, h: np.ndarray) -> dict[str, np.ndarray]:
        """States of a window and what backpropagation needs of them. Step t holds the first ``live[t]`` lanes, and steps stand one after the other."""
        p, n = self.p, len(given)
        x = np.take(p["x"], given, axis=0)
        kept = {k: np.empty((n, size * HIDDEN), x.dtype) for k, size in (("h", 1), ("prev", 1), ("zr", 2), ("q", 1), ("n", 1))}
        s = 0
        for k in live:
            at = slice(s, s + k)
            prev, zr, q, new, out = (kept[name][at] for name in ("prev", "zr", "q", "n", "h"))
            prev[:] = h[:k]
            if begin[at].any():
                prev[begin[at]] = 0
            g = prev @ p["u"]
            np.add(x[at, : 2 * HIDDEN], g[:, : 2 * HIDDEN], out=zr)
            np.negative(zr, out=zr)
            np.exp(zr, out=zr)
            zr += 1
            np.reciprocal(zr, out=zr)
            np.add(g[:, 2 * HIDDEN :], p["b"], out=q)
            np.multiply(zr[:, HIDDEN:], q, out=new)
            new += x[at, 2 * HIDDEN :]
            np.tanh(new, out=new)
            np.subtract(prev, new, out=out)
            out *= zr[:, :HIDDEN]
            out += new
            h = out
            s += k
        return kept

    def back(self, kept: dict[str, np.ndarray], begin: np.ndarray, live: np.ndarray, dout: np.ndarray, grads: dict) -> np.ndarray:
        """Gradients of a window by those of its states; returns the ones of its inputs."""
        prev, n, q = kept["prev"], kept["n"], kept["q"]
        z, r = kept["zr"][:, :HIDDEN], kept["zr"][:, HIDDEN:]
        dn = (1 - z) * (1 - n * n)
        # what a state's gradient is times, for each gate
        by = np.stack([(prev - n) * z * (1 - z), dn * q * r * (1 - r), dn * r], axis=1)
        g, all_dh = np.empty((len(n), 3, HIDDEN), n.dtype), np.empty_like(n)
        dh, ut = np.zeros((live[0], HIDDEN), n.dtype), np.ascontiguousarray(self.p["u"].T)
        s = len(n)
        for k in live[::-1]:
            s -= k
            at, d = slice(s, s + k), dh[:k]
            d += dout[at]
            all_dh[at] = d
            np.multiply(by[at], d[:, None, :], out=g[at])
            d *= z[at]
            d += g[at].reshape(k, 3 * HIDDEN) @ ut
            if begin[at].any():
                d[begin[at]] = 0
        flat = g.reshape(-1, 3 * HIDDEN)
        grads["u"], grads["b"] = prev.T @ flat, g[:, 2].sum(0)
        np.multiply(all_dh, dn, out=g[:, 2])
        return flat

    def output(self, h: np.ndarray, target: np.ndarray, grads: dict | None = None):
        """Natural log-probabilities of targets (class, and word or shape within it); gradients go to ``grads``."""
        cls = np.minimum(target // PER_CLASS, CLASSES).astype(np.int16)
        order = np.argsort(cls, kind="stable")  # by class, so those of each stand together
        h, cls, target = np.take(h, order, axis=0), cls[order], target[order]
        edges = np.searchsorted(cls, np.arange(CLASSES + 1, dtype=np.int16))
        there = [(c, slice(edges[c], edges[c + 1])) for c in range(CLASSES) if edges[c] < edges[c + 1]]

        def softmax(a: np.ndarray, k: np.ndarray) -> np.ndarray:
            """Log-probabilities of ``k``; ``a`` becomes the gradient."""
            rows = np.arange(len(a))
            a -= a.max(1, keepdims=True)
            own = a[rows, k]
            np.exp(a, out=a)
            total = a.sum(1, keepdims=True)
            if grads is not None:
                a /= total
                a[rows, k] -= 1
            return own - np.log(total[:, 0])

        a = h @ self.p["wc"]
        a += self.p["bc"]
        lp = softmax(a, cls).astype(np.float64)
        words = edges[CLASSES]
        b = np.take(self.p["bv"], cls[:words], axis=0)
        for c, at in there:
            b[at] += h[at] @ self.p["wv"][c]
        lp[:words] += softmax(b, target[:words] % PER_CLASS)
        o = h[words:] @ self.p["ws"]
        o += self.p["bs"]
        lp[words:] += softmax(o, target[words:] - VOCABULARY)
        out = np.empty_like(lp)
        out[order] = lp
        if grads is None:
            return out, None
        grads["wc"], grads["bc"] = h.T @ a, a.sum(0)
        grads["ws"], grads["bs"] = h[words:].T @ o, o.sum(0)
        grads["wv"], grads["bv"] = np.zeros_like(self.p["wv"]), np.zeros_like(self.p["bv"])
        d = a @ self.p["wc"].T
        d[words:] += o @ self.p["ws"].T
        for c, at in there:
            grads["wv"][c] = h[at].T @ b[at]
            d[at] += b[at] @ self.p["wv"][c].T
        if there:
            grads["bv"][[c for c, _ in there]] = np.add.reduceat(b, [at.start for _, at in there])
        dh = np.empty_like(d)
        dh[order] = d
        return out, dh


@dataclass
class Lanes:
    """Texts dealt to lanes of like length and read side by side: the tokens of step 0 of all lanes, then those of step 1.

    Lanes stand longest first, so those that still run at a step are the first ones, and no place is left empty.
    """

    token: np.ndarray  # number of the token that stands at a place
    live: np.ndarray  # lanes of each step
    at: np.ndarray  # first place of each step, and the end
    count: int

    @classmethod
    def of(cls, bounds: np.ndarray, lanes: int) -> Lanes:
        length = np.diff(bounds)
        heap = [(0, k) for k in range(min(lanes, len(length)))]
        deal: list[list[int]] = [[] for _ in heap]
        for i in np.argsort(-length, kind="stable").tolist():
            size, k = heap[0]
            deal[k].append(i)
            heapq.heapreplace(heap, (size + int(length[i]), k))
        sizes = np.zeros(len(deal), np.int64)
        for size, k in heap:
            sizes[k] = size
        longest = np.argsort(-sizes, kind="stable")
        sizes = sizes[longest]
        texts = np.array([i for k in longest for i in deal[k]], np.int64)
        n = length[texts]
        token = np.repeat(bounds[texts] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        live = len(sizes) - np.searchsorted(sizes[::-1], np.arange(sizes.max(initial=0)), "right")
        at = np.concatenate([[0], np.cumsum(live)])
        step = np.arange(len(token)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        laid = np.empty(len(token), np.int64)
        laid[at[step] + np.repeat(np.arange(len(sizes)), sizes)] = token
        return cls(laid, live, at, len(sizes))

    def windows(self) -> Iterator[tuple[slice, np.ndarray]]:
        """Places and lanes by step of each window. Where few lanes are left windows are longer, so they hold tokens enough to learn from."""
        t, steps = 0, len(self.live)
        while t < steps:
            end = min(steps, t + min(_LONGEST, max(_WINDOW, _WINDOW * self.count // int(self.live[t]))))
            yield slice(int(self.at[t]), int(self.at[end])), self.live[t:end]
            t = end


def _laid_out(ids: np.ndarray, bounds: np.ndarray, end: int, lanes: int) -> tuple[Lanes, np.ndarray, np.ndarray, np.ndarray]:
    """Lanes, and at each place the token to foresee, the one before it, and whether a text begins."""
    laid = Lanes.of(bounds, lanes)
    first = np.zeros(len(ids), bool)
    first[bounds[:-1]] = True
    begin = first[laid.token]
    return laid, ids[laid.token], np.where(begin, end, ids[laid.token - 1]), begin


def score_texts(net: Network, ids: np.ndarray, bounds: np.ndarray, end: int, lanes: int = 256) -> np.ndarray:
    """log10 probability of the classes and vocabulary words of each text; the state passes from window to window."""
    n = len(bounds) - 1
    laid, target, given, begin = _laid_out(ids, bounds, end, lanes)
    text = np.repeat(np.arange(n), np.diff(bounds))[laid.token]
    lp = np.zeros(len(ids))
    h = np.zeros((laid.count, HIDDEN), np.float32)
    for at, live in laid.windows():
        states = net.run(given[at], begin[at], live, h)["h"]
        h = states[len(states) - live[-1] :]
        lp[at] = net.output(states, target[at])[0]
    return np.bincount(text, weights=lp, minlength=n) / _LN10


class Trainer:
    """Adam over truncated windows of lanes of texts; of the input table only the rows that a window holds are moved."""

    def __init__(self, net: Network, rate: float = 0.004):
        self.net, self.rate, self.t = net, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in net.p.items()}
        self.v = {k: np.zeros_like(v) for k, v in net.p.items()}
        self.rows = np.zeros(0, np.int64)

    def fit(self, ids: np.ndarray, bounds: np.ndarray, end: int, lanes: int = 64) -> float:
        """One pass; returns the mean natural log-probability of a token."""
        laid, target, given, begin = _laid_out(ids, bounds, end, lanes)
        total, inputs = 0.0, np.zeros_like(self.net.p["x"])
        h = np.zeros((laid.count, HIDDEN), np.float32)
        for at, live in laid.windows():
            kept = self.net.run(given[at], begin[at], live, h)
            states = kept["h"]
            h = states[len(states) - live[-1] :]
            grads: dict[str, np.ndarray] = {}
            lp, dout = self.net.output(states, target[at], grads)
            total += lp.sum()
            dx = self.net.back(kept, begin[at], live, dout, grads)
            order = np.argsort(given[at].astype(np.int16), kind="stable")
            self.rows, first = np.unique(given[at][order], return_index=True)
            inputs[self.rows] = np.add.reduceat(np.take(dx, order, axis=0), first)
            grads["x"] = inputs
            self._update(grads, 1 / len(lp))
            inputs[self.rows] = 0
        return total / max(1, len(ids))

    def _update(self, grads: dict[str, np.ndarray], scale: float) -> None:
        self.t += 1
        grads = grads | {"x": grads["x"][self.rows]}
        norm = scale * float(np.sqrt(sum(float(np.vdot(g, g)) for g in grads.values())))
        scale *= min(1.0, 1.0 / max(norm, 1e-12))
        up, by = np.float32(self.rate / (1 - 0.9**self.t)), np.float32(1 / (1 - 0.995**self.t))
        for k, g in grads.items():
            own = (self.rows,) if k == "x" else (slice(None),)
            m, v = self.m[k][own], self.v[k][own]
            g *= np.float32(scale)
            m *= np.float32(0.9)
            m += np.float32(0.1) * g
            np.square(g, out=g)
            g *= np.float32(0.005)
            v *= np.float32(0.995)
            v += g
            if k == "x":
                self.m[k][own], self.v[k][own] = m, v
            np.multiply(v, by, out=g)
            np.sqrt(g, out=g)
            g += np.float32(1e-6)
            np.divide(m, g, out=g)
            g *= up
            self.net.p[k][own] -= g


@dataclass
class Vocabulary:
    """Counts that every task holds: hashes in order, their counts, and their places in the network (-1: by shape)."""

    hashes: np.ndarray
    counts: np.ndarray
    place: np.ndarray
    end: int

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.hashes, h), max(0, len(self.hashes) - 1))
        return at, self.hashes[at] == h if len(self.hashes) else np.zeros(len(h), bool)

    def ids(self, h: np.ndarray, shape: np.ndarray, found: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
        at, ok = self.find(h) if found is None else found
        place = np.where(ok, self.place[at] if len(self.place) else -1, -1)
        return np.where(place >= 0, place, VOCABULARY + shape).astype(np.int32)


def _gathered(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[list[pa.RecordBatch], np.ndarray, np.ndarray, np.ndarray]]:
    """Tokens of about ``size`` bytes of texts at a time."""
    held, total = [], 0
    for batch in batches:
        for part, data, offsets in slices(batch, "text"):
            held.append((part, *tokens_of(data, offsets)))
            total += len(data)
            if total > size:
                yield _joined(held)
                held, total = [], 0
    if held:
        yield _joined(held)


def _joined(held):
    shift = np.cumsum([0, *(len(x[1]) for x in held)])
    bounds = np.concatenate([np.zeros(1, np.int64), *(x[3][1:] + s for x, s in zip(held, shift, strict=False))])
    return [x[0] for x in held], np.concatenate([x[1] for x in held]), np.concatenate([x[2] for x in held]), bounds


def _texts_to_learn(batches: Iterator[pa.RecordBatch], words: Vocabulary) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and text bounds of about ``TRAIN_TOKENS`` tokens at a time; hashes are not held."""
    held, bounds = [], [np.zeros(1, np.int64)]
    for batch in batches:
        for _, data, offsets in slices(batch, "text"):
            h, s, b = tokens_of(data, offsets)
            held.append(words.ids(h, s))
            bounds.append(b[1:] + bounds[-1][-1])
            if bounds[-1][-1] > TRAIN_TOKENS:
                yield np.concatenate(held), np.concatenate(bounds)
                held, bounds = [], [np.zeros(1, np.int64)]
    if held:
        yield np.concatenate(held), np.concatenate(bounds)


def _trained(train: DataFrame, words: Vocabulary, counts: np.ndarray, shape_mass: np.ndarray) -> Network:
    net = Network()
    net.start_from(counts, shape_mass)
    spark = train.sparkSession
    by_hash = train.withColumn("_r", F.xxhash64("doc_id", "text"))
    some = by_hash.orderBy("_r").select("text").limit(1000).toArrow()  # bounded: texts for the first weights only
    h, s, b = [], [], [0]
    for batch in some.to_batches():
        for _, data, offsets in slices(batch, "text"):
            if b[-1] < WARM_TOKENS:
                x, y, z = tokens_of(data, offsets)
                h.append(x)
                s.append(y)
                b.extend(b[-1] + z[1:])
    if len(b) == 1:
        return net
    ids, bounds = words.ids(np.concatenate(h), np.concatenate(s)), np.array(b)
    first = Trainer(net)
    for _ in range(WARM_ROUNDS):
        first.fit(ids, bounds, words.end)
    # every task goes on from these weights with its share of the corpus; the weights are then averaged
    shared = spark.sparkContext.broadcast((net.p, words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, own = shared.value
        local = Trainer(Network(p={k: v.copy() for k, v in p.items()}), rate=0.002)
        seen = 0
        for ids, bounds in _texts_to_learn(batches, own):
            local.fit(ids, bounds, own.end, lanes=TRAIN_LANES)
            seen += len(ids)
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([seen]), *(pa.array([(v.astype(np.float64) * seen).astype(np.float32).tobytes()], pa.binary()) for v in local.net.p.values())], ["n", *local.net.p])

    def mean(table: pa.Table) -> pa.Table:
        return pa.table({"n": pa.array([int(np.sum(table.column("n").to_numpy()))])} | {k: pa.array([sum(np.frombuffer(c.as_buffer(), np.float32).astype(np.float64) for c in table.column(k)).astype(np.float32).tobytes()], pa.binary()) for k in net.p})

    kinds = "n long, " + ", ".join(f"{k} binary" for k in net.p)
    # as the table lies, so no text is shuffled; many small parts are taken together, as short runs hardly move the weights
    got = train.select("text").coalesce(width(spark)).mapInArrow(run, kinds).groupBy((F.spark_partition_id() % 6).alias("q")).applyInArrow(mean, kinds).toArrow().to_pylist()
    if got:
        n = net.seen = sum(r["n"] for r in got)
        for k, v in net.p.items():
            total = sum(np.frombuffer(r[k], np.float32).astype(np.float64) for r in got)
            net.p[k] = (total / n).astype(np.float32).reshape(v.shape)
    return net


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of ``docs``.

    Training texts are those whose crc32(id) mod 5 is not 1. Scores are log10 probabilities of whole texts,
    ends included; base_score is the smoothed unigram's, score the network's. The state starts at each text's
    beginning and is carried over all its windows.

    Null and empty texts hold the end token only. Rows that repeat an id are scored row by row. Without any
    training text all tokens are unknown. An empty table gives an empty result. Only the named columns are read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    train = rows.where(~held_out("doc_id", 5, 1))
    counts = cut(_count(train))
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    base = np.log10(total + 0.5 * (distinct + 1))
    top = counts.orderBy(F.desc("c"), "h").limit(SHARED).toArrow()
    h, c = top.column("h").to_numpy(), top.column("c").to_numpy()
    in_net = np.argsort(np.lexsort((h, -c))) < VOCABULARY
    place = np.where(in_net, np.argsort(np.lexsort((h, -c))), -1).astype(np.int32)
    order = np.argsort(h)
    ends = place[h == _END]
    words = Vocabulary(h[order], c[order], place[order], int(ends[0]) if len(ends) and ends[0] >= 0 else VOCABULARY)
    vocab = np.sort(c[in_net])[::-1]
    mass = np.zeros(_SHAPES)
    for r in counts.groupBy("shape").agg((F.sum("c") + 0.5 * F.count(F.lit(1))).alias("m")).collect():
        mass[r["shape"]] = r["m"]
    shape_of = top.column("shape").to_numpy()
    np.subtract.at(mass, shape_of[in_net], c[in_net] + 0.5)
    mass = np.maximum(mass, 0) + 0.5
    net = _trained(train, words, vocab, mass)
    log_mass = np.log10(mass)
    shared = spark.sparkContext.broadcast((net, words))

    def uid(part: pa.RecordBatch, h: np.ndarray, bounds: np.ndarray, i0: int) -> np.ndarray:
        d = part.column("doc_id")
        ids = d.fill_null(-1).to_numpy().view(np.uint64)
        up = np.uint64(0x9E3779B97F4A7C15)
        n = len(ids)
        at = np.arange(len(h), dtype=np.uint64) - np.repeat((bounds[i0 : i0 + n] - bounds[i0]).astype(np.uint64), np.diff(bounds[i0 : i0 + n + 1])) if n else np.zeros(0, np.uint64)
        text = np.add.reduceat(mix(h.view(np.uint64) + mix(at + up)), bounds[i0 : i0 + n] - bounds[i0]) if n else np.zeros(0, np.uint64)
        return signed(mix(ids * up + text))

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value[1]
        for batch in batches:
            for part, data, offsets in slices(batch, "text"):
                h, _, b = tokens_of(data, offsets)
                text = np.repeat(uid(part, h, b, 0), np.diff(b))
                new = ~own.find(h)[1]
                h, text = h[new], text[new]
                for i in range(0, len(h), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(h[i : i + 100_000]), pa.array(text[i : i + 100_000])], ["h", "uid"])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, own = shared.value
        for parts, h, s, b in _gathered(batches, 1 << 23):
            at, ok = own.find(h)
            ids = own.ids(h, s, (at, ok))
            text = np.repeat(np.arange(len(b) - 1), np.diff(b))
            logs = np.where(ok, np.log10(own.counts[at] + 0.5), 0.0) if len(own.counts) else np.zeros(len(h))
            outside = ids >= VOCABULARY
            n = len(b) - 1
            got = score_texts(model, ids, b, own.end)
            got += np.bincount(text, weights=np.where(outside, logs - log_mass[np.where(outside, ids - VOCABULARY, 0)], 0.0), minlength=n)
            known, sums = np.bincount(text, weights=ok, minlength=n).astype(np.int64), np.bincount(text, weights=logs, minlength=n)
            i = 0
            for part in parts:
                j = i + len(part)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(uid(part, h[b[i] : b[j]], b, i)), pa.array(np.diff(b[i : j + 1])), pa.array(known[i:j]), pa.array(sums[i:j]), pa.array(got[i:j])], ["doc_id", "uid", "n_tokens", "known", "logs", "net"])
                i = j

    main = rows.mapInArrow(scored, "doc_id long, uid long, n_tokens long, known long, logs double, net double")
    # tokens outside the shared counts meet their counts in a join; copies of a row fall together and are shared out
    found = rows.mapInArrow(rare, "h long, uid long").join(counts.select("h", "c").hint("merge"), "h", "left")
    found = found.groupBy("uid").agg(F.sum(F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("more"), F.count("c").alias("known_more"))
    several = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("k")).where("k > 1").limit(1).count() > 0
    main = cut(main)
    if several:
        times = main.groupBy("uid").agg(F.count(F.lit(1)).alias("k"))
        found = found.join(times, "uid").select("uid", (F.col("more") / F.col("k")).alias("more"), (F.col("known_more") / F.col("k")).cast("long").alias("known_more"))
    out = main.join(found, "uid", "left")
    more = F.coalesce("more", F.lit(0.0))
    return out.select(
        "doc_id", held_out("doc_id", 5, 1).alias("held_out"), "n_tokens", (F.col("known") + F.coalesce("known_more", F.lit(0))).alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"), (F.col("logs") + more - F.col("n_tokens") * F.lit(float(base))).alias("base_score"), (F.col("net") + more).alias("score"),
    )


def op7_gru_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
