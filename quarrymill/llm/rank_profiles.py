"""Language ID by rank-order n-gram profiles and out-of-place distance."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrymill.llm.cluster import held_out
from quarrymill.llm.words import slices

#: N-grams of a language's profile, and of a document's.
PROFILE, DOC_PROFILE = 400, 300
#: Languages that may be learned; their profiles are collected and sent to the tasks.
MAX_LANGS = 10_000
_DENSE = 1 << 20
#: Code of a word's edge within grams; U+0001 is no letter.
EDGE = 1


@lru_cache(1)
def _fold() -> np.ndarray:
    """Code point to lower-cased letter, 0 for all that is no letter."""
    table = np.zeros(0x110000, np.int32)
    for cp in range(0x110000):
        c = chr(cp)
        if c.isalpha():
            low = c.lower()
            table[cp] = ord(low) if len(low) == 1 else cp
    return table


def letters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letters of each text with one 0 around each run of others, and the range of each text.

    A text of n runs of letters gives the runs between n + 1 zeros; one without a letter gives nothing.
    """
    chars = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    first = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    bounds = first[offsets]
    n = len(offsets) - 1
    at = np.repeat(np.arange(n), np.diff(bounds))
    folded = _fold()[chars]
    # a zero ahead of each text, then runs of zeros become one
    folded = np.insert(folded, bounds[:-1], 0)
    at = np.insert(at, bounds[:-1], np.arange(n))
    keep = np.ones(len(folded), bool)
    keep[1:] = (folded[1:] != 0) | (folded[:-1] != 0) | (at[1:] != at[:-1])
    folded, at = folded[keep], at[keep]
    ends = np.searchsorted(at, np.arange(n + 1))
    tail = np.flatnonzero((np.diff(ends) > 1) & (folded[np.maximum(ends[1:] - 1, 0)] != 0))
    folded = np.insert(folded, ends[1:][tail], 0)
    at = np.insert(at, ends[1:][tail], tail)
    ends = np.searchsorted(at, np.arange(n + 1))
    some = np.bincount(at, weights=folded != 0, minlength=n) > 0
    return folded, np.stack([ends[:-1], np.where(some, ends[1:], ends[:-1])])


def grams(seq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes and counts of the 1- to 3-grams of a sequence, 21 bits a sign; a 0 of the sequence, a word's edge, is ``EDGE``.

    An edge alone is no gram, and two edges that meet, as where sequences are joined, are in none.
    """
    if not len(seq):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    alphabet = np.flatnonzero(np.bincount(seq)) if seq.max() < 0x3000 else np.unique(seq)
    k = len(alphabet)
    x = np.searchsorted(alphabet, seq).astype(np.int64)
    wide = np.where(alphabet == 0, EDGE, alphabet).astype(np.int64)
    out = []
    for n in (1, 2, 3):
        if len(x) < n:
            continue
        code = x.copy() if n == 1 else x[:-1] * k + x[1:] if n == 2 else (x[:-2] * k + x[1:-1]) * k + x[2:]
        if k**n <= max(_DENSE // 4, 4 * len(x)):
            count = np.bincount(code)
            code = np.flatnonzero(count)
            count = count[code]
        else:
            code, count = np.unique(code, return_counts=True)
        full = wide[code % k]
        for j in range(1, n):
            full |= wide[code // k**j % k] << (21 * j)
        edges = [(full >> (21 * j)) & 0x1FFFFF == EDGE for j in range(n)]
        bad = edges[0] if n == 1 else edges[0] & edges[1] if n == 2 else edges[1] & (edges[0] | edges[2])
        out.append((full[~bad], count[~bad]))
    return np.concatenate([c for c, _ in out]), np.concatenate([c for _, c in out])


def _top(code: np.ndarray, count: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` most frequent codes, ties by code."""
    if len(code) > k:
        edge = np.partition(count, len(count) - k)[len(count) - k]
        near = count >= edge
        code, count = code[near], count[near]
    return code[np.lexsort((code, -count))][:k]


def _counts(train: DataFrame) -> DataFrame:
    """(lang, gram, n) over all training texts, summed within each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}

        def flush():
            for lang, parts in held.items():
                code = np.concatenate([p[0] for p in parts])
                u, inv = np.unique(code, return_inverse=True)
                n = np.bincount(inv, weights=np.concatenate([p[1] for p in parts])).astype(np.int64)
                for i in range(0, len(u), 50_000):
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(u[i : i + 50_000])), pa.array(u[i : i + 50_000]), pa.array(n[i : i + 50_000])], ["lang", "gram", "n"])

        size = 0
        for batch in batches:
            for part, data, offsets in slices(batch, "text"):
                seq, (a, e) = letters(data, offsets)
                langs = np.array(part.column("lang").to_pylist(), object)
                for lang in set(langs):
                    own = [seq[a[i] : e[i]] for i in np.flatnonzero(langs == lang)]
                    code, count = grams(np.concatenate(own))  # texts begin and end with an edge, so no gram spans two
                    held.setdefault(lang, []).append((code, count))
                    size += len(code)
                if size > 4_000_000:
                    yield from flush()
                    held, size = {}, 0
        yield from flush()

    return train.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def learn(docs: DataFrame, text_col: str, lang_col: str, profile: int = PROFILE) -> dict[str, np.ndarray]:
    """The most frequent n-grams of each language in order, from all rows of ``docs`` with a language."""
    train = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    ranked = _counts(train).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= profile)
    got = ranked.select("lang", "gram", "rank").limit(MAX_LANGS * profile + 1).toArrow().to_pandas()
    if len(got) > MAX_LANGS * profile:
        raise ValueError(f"more than {MAX_LANGS} languages")
    return {k: g.sort_values("rank")["gram"].to_numpy() for k, g in sorted(got.groupby("lang"))}


class Profiles:
    """Out-of-place distances of a document's grams to all profiles at once."""

    def __init__(self, by_lang: dict[str, np.ndarray], profile: int = PROFILE):
        self.langs = sorted(by_lang)
        self.miss = profile
        self.codes = np.unique(np.concatenate([by_lang[k] for k in self.langs])) if by_lang else np.zeros(0, np.int64)
        self.rank = np.full((len(self.langs), len(self.codes) + 1), -1, np.int32)
        for i, k in enumerate(self.langs):
            self.rank[i, np.searchsorted(self.codes, by_lang[k])] = np.arange(len(by_lang[k]))

    def predict(self, seq: np.ndarray, doc_profile: int = DOC_PROFILE) -> tuple[str, float]:
        """(language, 1 - distance / greatest distance); ties go to the first language by name."""
        if not len(seq) or not self.langs:
            return "und", 0.0
        top = _top(*grams(seq), doc_profile)
        at = np.searchsorted(self.codes, top)
        at[(at == len(self.codes)) | (self.codes[np.minimum(at, len(self.codes) - 1)] != top)] = len(self.codes)
        ranks = self.rank[:, at]
        far = np.where(ranks < 0, self.miss, np.minimum(np.abs(ranks - np.arange(len(top))), self.miss)).sum(1)
        best = int(far.argmin())
        return self.langs[best], float(1 - far[best] / (self.miss * len(top)))


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", profile: int = PROFILE, doc_profile: int = DOC_PROFILE) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of ``docs``.

    Profiles are learned from all texts with a language whose crc32(id) mod 4 is not 2. A document goes to
    the language with the least out-of-place distance; ``score`` is one less that distance over the greatest
    possible. Null texts and texts without a letter are ``und`` with score 0, and so is everything if no
    language can be learned. Texts count whole. Repeated ids are rows of their own; an empty table gives an
    empty result; other columns are not read.
    """
    profiles = Profiles(learn(docs.where(~held_out(id_col, 4, 2)), text_col, lang_col, profile), profile)
    shared = docs.sparkSession.sparkContext.broadcast(profiles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in slices(batch, "_text"):
                seq, (a, e) = letters(data, offsets)
                got = [shared.value.predict(seq[a[i] : e[i]], doc_profile) for i in range(len(part))]
                yield pa.RecordBatch.from_arrays([part.column("_id"), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], ["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    out = rows.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
    return out.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(spark.read.parquet(f"{sf_dir}/documents.parquet"))
