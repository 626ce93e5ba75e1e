"""Quality classifier: Bradley-Terry scores learned from preference pairs, thresholded by score or by quantile."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.llm.cluster import held_out
from quarrymill.llm.words import Words, slices

_MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
N_FEATURES = 12 + len(_MARKS) * 2
#: Labelled rows that training reads at most, the smallest hashes of their ids.
MAX_TRAIN = 20_000
#: Preferred texts that each rejected text is set against, and the other way round.
PAIRS_PER_ROW = 8
#: Pairs whose differences the driver holds at once, 5 MB.
_BLOCK = 8192


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of features for each text of a run, from the whole of it; an empty text is all zeros."""
    n = len(offsets) - 1
    out = np.zeros((n, N_FEATURES))
    if not len(data):
        return out
    w = Words(data, offsets)
    size = np.diff(offsets).astype(float)
    doc = np.repeat(np.arange(n), np.diff(offsets))
    byte = np.bincount(doc * 256 + data, minlength=n * 256).reshape(n, 256).astype(float)
    some = np.maximum(size, 1)
    h = w.hashes()
    counts = np.diff(w.bounds).astype(float)
    word_doc = np.repeat(np.arange(n), np.diff(w.bounds))
    per = np.maximum(counts, 1)
    same = np.zeros(len(h))
    if len(h) > 1:
        same[1:] = (h[1:] == h[:-1]) & (word_doc[1:] == word_doc[:-1])
    distinct, top = np.zeros(n), np.zeros(n)
    order = np.lexsort((h, word_doc))
    if len(h):
        hs, ds = h[order], word_doc[order]
        new = np.ones(len(h), bool)
        new[1:] = (hs[1:] != hs[:-1]) | (ds[1:] != ds[:-1])
        at = np.flatnonzero(new)
        distinct = np.bincount(ds[at], minlength=n).astype(float)
        np.maximum.at(top, ds[at], np.diff(np.append(at, len(h))))
    upper = byte[:, 65:91].sum(1)
    lines = byte[:, 10] + 1
    out[:, 0] = upper / some
    out[:, 1] = byte[:, 48:58].sum(1) / some
    out[:, 2] = byte[:, 128:].sum(1) / some
    out[:, 3] = np.bincount(word_doc, weights=same, minlength=n) / per
    out[:, 4] = distinct / per
    out[:, 5] = top / per
    out[:, 6] = np.log1p(counts)
    out[:, 7] = np.log1p(distinct)
    out[:, 8] = np.log1p(counts / lines)
    out[:, 9] = (size - byte[:, 32]) / per / 8
    out[:, 10] = np.log1p(lines)
    out[:, 11] = np.log1p(np.bincount(word_doc, weights=same, minlength=n))
    marks = byte[:, list(_MARKS)]
    out[:, 12 : 12 + len(_MARKS)] = np.minimum(marks / per[:, None], 3)
    out[:, 12 + len(_MARKS) :] = np.log1p(marks)
    return out


@dataclass(frozen=True)
class Ranker:
    """Linear scores of standardised features; ``a`` and ``b`` turn a score into a probability."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    a: float
    b: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6) @ self.weights

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.a * self.raw(x) + self.b, -500, 500)))


def _newton(x: np.ndarray, y: np.ndarray, ridge: np.ndarray, pairs: tuple[np.ndarray, np.ndarray] | None = None, rounds: int = 40) -> np.ndarray:
    """Logistic regression with a ridge; the step is halved until the loss falls.

    With ``pairs`` (i, j) its rows are x[i] - x[j], of which only a block is laid out at a time.
    """
    w = np.zeros(x.shape[1])

    def times(v):
        s = x @ v
        return s if pairs is None else s[pairs[0]] - s[pairs[1]]

    def loss(v):
        return np.logaddexp(0, -y * times(v)).sum() + 0.5 * (ridge * v * v).sum()

    now = loss(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(np.clip(y * times(w), -500, 500)))
        grad, hess = ridge * w, np.diag(ridge + 1e-9)
        for k in range(0, len(y), _BLOCK):
            at = slice(k, k + _BLOCK)
            d = x[at] if pairs is None else x[pairs[0][at]] - x[pairs[1][at]]
            grad -= d.T @ (y[at] * p[at])
            hess += (d * (p[at] * (1 - p[at]))[:, None]).T @ d
        step = np.linalg.solve(hess, grad)
        t = 1.0
        while t > 1e-6 and (then := loss(w - t * step)) > now:
            t /= 2
        if t <= 1e-6 or now - then < 1e-8 * max(1, now):
            break
        w, now = w - t * step, then
    return w


def fit(x: np.ndarray, label: np.ndarray, pairs_per_row: int = PAIRS_PER_ROW, ridge: float = 1.0, seed: int = 7) -> Ranker:
    """Bradley-Terry weights: logistic loss on the feature differences of (preferred, rejected) pairs.

    A table without one of the labels gives a ranker that says 0.5 (no label), or that label's share.
    """
    mean, scale = (x.mean(0), x.std(0)) if len(x) else (np.zeros(N_FEATURES), np.ones(N_FEATURES))
    scale = np.where(scale > 1e-9, scale, 1.0)
    z = np.clip((x - mean) / scale, -6, 6)
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    if not len(good) or not len(bad):
        share = (len(good) + 0.5) / (len(x) + 1)
        return Ranker(mean, scale, np.zeros(N_FEATURES), 0.0, float(np.log(share / (1 - share))))
    rng = np.random.default_rng(seed)
    i = np.concatenate([np.repeat(good, pairs_per_row), rng.choice(good, len(bad) * pairs_per_row)])
    j = np.concatenate([rng.choice(bad, len(good) * pairs_per_row), np.repeat(bad, pairs_per_row)])
    w = _newton(z, np.ones(len(i)), np.full(N_FEATURES, ridge), (i, j))
    s = z @ w
    # for probabilities, the scores are fitted to the labels themselves
    ab = _newton(np.stack([s, np.ones(len(s))], 1), np.where(label == 1, 1.0, -1.0), np.array([1e-3, 1e-6]))
    return Ranker(mean, scale, w, float(ab[0]), float(ab[1]))


def _features_of(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in slices(batch, "text"):
                x = features(data, offsets)
                yield pa.RecordBatch.from_arrays([part.column("label").cast(pa.int32()), pa.array([r.tobytes() for r in x], pa.binary())], ["label", "x"])

    return rows.select("text", "label").mapInArrow(run, "label int, x binary")


def train(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, max_train: int = MAX_TRAIN) -> Ranker:
    """Fit on at most ``max_train`` labelled rows (those with the smallest hash of their id); null labels do not count."""
    named = labels.where(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    chosen = named.dropDuplicates(["id"]).orderBy(F.xxhash64("id"), "id").limit(max_train)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")
    got = _features_of(rows).limit(max_train * 2).toArrow()  # bounded: repeated ids at most double the sample
    x = np.frombuffer(b"".join(got.column("x").to_pylist()), float).reshape(-1, N_FEATURES)
    y = np.array(got.column("label").to_pylist(), int)
    order = np.lexsort((*x.T, y))
    return fit(x[order], y[order])


def score(docs: DataFrame, ranker: Ranker, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` ids with ``score`` (probability of label 1) and ``raw`` (the Bradley-Terry score) of the whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in slices(batch, "_text"):
                x = features(data, offsets)
                yield pa.RecordBatch.from_arrays([part.column("_id"), pa.array(ranker.probability(x)), pa.array(ranker.raw(x))], ["doc_id", "score", "raw"])

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, score double, raw double")


def quality_classifier(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    threshold: float | None = 0.3,
    reject_quantile: float | None = None,
    max_train: int = MAX_TRAIN,
) -> DataFrame:
    """doc_id, held_out, score, predicted, raw for every row of ``docs``.

    Labels of rows with crc32(id) mod 5 = 0 are held out. ``predicted`` is 1 where the score reaches
    ``threshold``, or, with ``reject_quantile``, where it is above that quantile of all scores.
    Null and empty texts have all features zero and get the score of such a text. Without labels of both
    kinds every score is the smoothed share of label 1 (0.5 without any). Repeated ids are scored row by
    row; an empty table gives an empty result; only the named columns are read.
    """
    seen = labels.where(~held_out(id_col, 5, 0))
    ranker = train(docs, seen, id_col, text_col, label_col, max_train)
    out = score(docs, ranker, id_col, text_col)
    if reject_quantile is not None:
        threshold = out.agg(F.percentile_approx("score", reject_quantile, 100_000)).first()[0]
        threshold = 0.0 if threshold is None else threshold
    return out.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= F.lit(threshold)).cast("int").alias("predicted"), "raw")


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.3, max_train: int = MAX_TRAIN) -> DataFrame:
    """``docs`` without the rows that the classifier rejects, all columns as they are; rows pass through, nothing is joined."""
    ranker = train(docs, labels.where(~held_out(id_col, 5, 0)), id_col, text_col, label_col, max_train)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in slices(batch, text_col):
                yield part.filter(pa.array(ranker.probability(features(data, offsets)) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
