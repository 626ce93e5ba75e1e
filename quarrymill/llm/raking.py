"""Mixing sources to target weights by iterative proportional fitting (raking)."""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.llm.cluster import BROADCAST_ROWS, cut, written

DIMENSIONS = ("source", "lang", "topic")
#: Raking ends when all ratios are this near to 1, or after so many rounds; wherever it runs.
ROUNDS, TOLERANCE = 200, 1e-9
#: Hash values of ids are compared with probabilities in this many steps.
_STEPS = 1 << 52


def topic_of(text: Column) -> Column:
    """A coarse topic by the form of the whole text: legal notes, tables, contacts, long and short prose."""
    text = F.coalesce(text, F.lit(""))
    return (
        F.when(F.contains(text, F.lit("icensed under")) | F.contains(text, F.lit("icense.")), "legal")
        .when(F.contains(text, F.lit(" | ")), "table")
        .when(F.contains(text, F.lit("@")) | F.contains(text, F.lit("token = ")), "contact")
        .when(F.length(text) >= 2000, "long_prose")
        .otherwise("short_prose")
    )


def token_count(text: Column) -> Column:
    """Words between white space."""
    bare = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x09-\\x0D ]+", " "))
    return F.when(bare == "", F.lit(0)).otherwise(F.length(bare) - F.length(F.replace(bare, F.lit(" "), F.lit(""))) + 1).cast("long")


def rake(mass: np.ndarray, index: list[np.ndarray], targets: list[np.ndarray], rounds: int = ROUNDS, tolerance: float = TOLERANCE, start: np.ndarray | None = None) -> np.ndarray:
    """Factors of cells such that their weighted masses meet each marginal; ``index`` gives each cell's value by dimension.

    With ``start``, no weighted mass exceeds its cell's mass: fitting goes on from there, and where a cell is full the
    other cells of its values make up for it.
    """
    bounded = start is not None
    w = np.minimum(start, mass) if bounded else mass.astype(float)
    for _ in range(rounds):
        before = w
        for at, want in zip(index, targets, strict=True):
            full = w >= mass if bounded else np.zeros(len(w), bool)
            have, held = (np.bincount(at, weights=x, minlength=len(want)) for x in (w, w * full))
            over = have > want
            ratio = np.divide(want, have, out=np.ones_like(want), where=over)
            ratio = np.divide(want - held, have - held, out=ratio, where=~over & (have > held))
            w = w * np.where(full & ~over[at], 1.0, ratio[at])
            w = np.minimum(w, mass) if bounded else w
        if (np.abs(w - before) <= tolerance * np.maximum(mass, w)).all():
            break
    return np.divide(w, mass, out=np.zeros_like(w), where=mass > 0)


def _filled(share: np.ndarray, room: np.ndarray, total: float) -> np.ndarray:
    """``total`` dealt out by ``share``, no value getting more than its ``room``; what one cannot take goes to the others."""
    scale = total
    while True:
        got = np.minimum(room, share * scale)
        left = share[share * scale < room].sum()
        more = (total - got.sum()) / left if left > 0 else 0.0
        if more <= 1e-12 * scale:
            return got
        scale += more


def _even(values: list) -> dict:
    return {v: 1 / len(values) for v in values}


def _factors_here(cells: DataFrame, targets: Mapping[str, Mapping | None], keep_share: float, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    rows = sorted((tuple(r) for r in cells.select(*DIMENSIONS, "tokens").collect()), key=lambda r: tuple((x is not None, str(x)) for x in r[:3]))
    mass = np.array([r[3] for r in rows], float)
    total = mass.sum()
    index, wants, able = [], [], []
    for d, name in enumerate(DIMENSIONS):
        values = sorted({r[d] for r in rows if r[3]}, key=lambda x: (x is not None, str(x)))
        given = targets.get(name) or _even(values)
        share = np.array([max(0.0, float(given.get(v, 0.0))) for v in values] or [1.0])
        share = share / share.sum() if share.sum() > 0 else np.full(len(share), 1 / len(share))
        place = {v: i for i, v in enumerate(values)}
        index.append(np.array([place.get(r[d], 0) for r in rows], int))
        wants.append(share * total)
        able.append(_filled(share, np.bincount(index[-1], weights=mass, minlength=len(share)), keep_share * total))
    factor = rake(mass, index, wants, rounds, tolerance) if len(rows) else mass
    # no document is taken twice, so shares are fitted again with the cells' masses as bounds
    prob = np.clip(rake(mass, index, able, rounds, tolerance, start=mass * factor * keep_share), 0, 1) if len(rows) else mass
    data = [(*r[:3], float(f), float(p)) for r, f, p in zip(rows, factor, prob, strict=True)]
    kinds = ", ".join(f"{n} string" for n in DIMENSIONS)
    return cells.sparkSession.createDataFrame(data, f"{kinds}, weight double, probability double")


def _factors_spread(cells: DataFrame, targets: Mapping[str, Mapping | None], keep_share: float, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """The same where there are too many cells for the driver: a round is an aggregate and a join for each dimension."""
    spark = cells.sparkSession
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    wants, able = {}, {}
    for name in DIMENSIONS:
        values = cells.where("tokens > 0").groupBy(F.col(name).alias("_v")).agg(F.sum("tokens").cast("double").alias("_room"))
        given = targets.get(name)
        if given:
            shares = spark.createDataFrame([(v if v is None else str(v), max(0.0, float(s))) for v, s in given.items()], "_g string, _s double")
            values = values.join(shares, F.col("_v").eqNullSafe(F.col("_g")), "left").select("_v", "_room", F.coalesce("_s", F.lit(0.0)).alias("_share"))
        else:
            values = values.withColumn("_share", F.lit(1.0))
        values = cut(values)
        n, whole = values.agg(F.count(F.lit(1)), F.sum("_share")).first()
        values = values.select("_v", "_room", (F.col("_share") / whole if whole else F.lit(1.0 / max(1, n))).alias("_share"))
        wants[name] = values.select("_v", (F.col("_share") * total).alias("_want"))
        able[name] = values.select("_v", F.least("_room", F.col("_share") * _scale(values, keep_share * total)).alias("_want"))
    now, drop = written(cells.where("tokens > 0").withColumn("w", F.col("tokens").cast("double")))
    now, drop = _rounds(now, drop, wants, False, rounds, tolerance)
    bound, drop_bound = written(now.withColumn("_weight", F.col("w") / F.col("tokens")).withColumn("w", F.least(F.col("tokens").cast("double"), F.col("w") * keep_share)))
    drop()
    bound, drop_bound = _rounds(bound, drop_bound, able, True, rounds, tolerance)
    fitted = bound.select(*[F.col(c).alias(f"_{c}") for c in DIMENSIONS], "_weight", F.least(F.lit(1.0), F.col("w") / F.col("tokens")).alias("_probability"))
    factor = cells.join(fitted, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in DIMENSIONS], "left")
    factor = cut(factor.select(*DIMENSIONS, F.coalesce("_weight", F.lit(0.0)).alias("weight"), F.coalesce("_probability", F.lit(0.0)).alias("probability")))
    drop_bound()
    return factor


def _scale(values: DataFrame, total: float) -> float:
    """The factor of ``_filled`` for a table of values (_share, _room); it grows from below, and each step fills a value or ends."""
    scale, share = total, F.col("_share")
    while True:
        got, left = values.agg(F.sum(F.least("_room", share * scale)), F.sum(F.when(share * scale < F.col("_room"), share).otherwise(0.0))).first()
        more = (total - got) / left if left else 0.0
        if more <= 1e-12 * scale:
            return scale
        scale += more


def _rounds(now: DataFrame, drop, wants: Mapping[str, DataFrame], bounded: bool, rounds: int, tolerance: float):
    """``rake`` as steps on a written table of cells with w: an aggregate and a join for each dimension."""
    for _ in range(rounds):
        step = now.withColumn("_before", F.col("w"))
        for name, want in wants.items():
            full = (F.col("w") >= F.col("tokens")) if bounded else F.lit(False)
            have = step.groupBy(F.col(name).alias("_n")).agg(F.sum("w").alias("_have"), F.sum(F.when(full, F.col("w")).otherwise(0.0)).alias("_held"))
            over = F.col("_have") > F.col("_want")
            ratio = F.when(over, F.col("_want") / F.col("_have")).when(F.col("_have") > F.col("_held"), (F.col("_want") - F.col("_held")) / (F.col("_have") - F.col("_held"))).otherwise(1.0)
            ratios = cut(have.join(want, F.col("_n").eqNullSafe(F.col("_v"))).select("_n", over.alias("_over"), ratio.alias("_ratio")))
            w = F.when(full & ~F.col("_over"), F.col("w")).otherwise(F.col("w") * F.col("_ratio"))
            w = F.least(w, F.col("tokens").cast("double")) if bounded else w
            step = step.join(ratios, F.col(name).eqNullSafe(F.col("_n"))).withColumn("w", w).drop("_n", "_over", "_ratio")
        after, drop_next = written(step)
        off = after.where(F.abs(F.col("w") - F.col("_before")) > tolerance * F.greatest(F.col("tokens").cast("double"), F.col("w")))
        settled = off.isEmpty()
        drop()  # a round's table is read by the next alone
        now, drop = after.drop("_before"), drop_next
        if settled:
            break
    return now, drop


def _cells(docs: DataFrame, source_col: str, lang_col: str, text_col: str, topic: Column | None) -> list[Column]:
    return [F.col(source_col).cast("string").alias("_source"), F.col(lang_col).cast("string").alias("_lang"), (topic if topic is not None else topic_of(F.col(text_col))).alias("_topic"), token_count(F.col(text_col)).alias("_tokens")]


def _with_probability(rows: DataFrame, id_col: str, targets, keep_share: float, seed: int, max_local_cells: int) -> DataFrame:
    """``rows`` (with _source, _lang, _topic, _tokens) and _weight, _probability, _sampled."""
    cells = cut(rows.groupBy("_source", "_lang", "_topic").agg(F.sum("_tokens").alias("tokens")).toDF(*DIMENSIONS, "tokens"))
    n = cells.count()
    factors = (_factors_here if n <= max_local_cells else _factors_spread)(cells, targets or {}, keep_share)
    side = factors.select(*[F.col(c).alias(f"_f_{c}") for c in DIMENSIONS], F.col("weight").alias("_weight"), F.col("probability").alias("_probability"))
    on = [F.col(f"_{c}").eqNullSafe(F.col(f"_f_{c}")) for c in DIMENSIONS]
    out = rows.join(F.broadcast(side) if n <= BROADCAST_ROWS else side, on, "left").fillna(0.0, ["_weight", "_probability"])
    u = F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(_STEPS)) / F.lit(float(_STEPS))
    return out.withColumn("_sampled", u < F.col("_probability"))


def mix_to_targets(
    docs: DataFrame,
    targets: Mapping[str, Mapping | None] | None = None,
    keep_share: float = 0.5,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    lang_col: str = "lang",
    topic: Column | None = None,
    seed: int = 0,
    max_local_cells: int = BROADCAST_ROWS,
) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, weight, probability, sampled for every row of ``docs``.

    Token masses of (source, language, topic) cells are raked to the ``targets`` (shares of tokens by value;
    a dimension without targets is split evenly): ``weight``. For ``probability`` they are raked again with every
    cell bounded by what it holds, so that ``keep_share`` of all tokens is expected to stay, in the shares wanted as
    far as the values hold enough; what a value lacks the others of its dimension make up for. A document is sampled where the hash of its id and ``seed`` falls below its cell's
    probability, so a rerun takes the same documents and copies of a row share their fate.

    Values that have targets but no documents, or documents but no share, get nothing and the rest is scaled.
    Null source or language is a value of its own (share 0 where targets are given and do not name it).
    Documents without tokens have mass 0 and are sampled like the rest of their cell; cells of such documents
    alone have probability 0. Null ids are sampled alike. An empty table gives an empty result. Columns other
    than the named ones are not read.
    """
    rows = cut(docs.select(F.col(id_col).alias("doc_id"), *_cells(docs, source_col, lang_col, text_col, topic)))  # texts are read once
    out = _with_probability(rows, "doc_id", targets, keep_share, seed, max_local_cells)
    return out.select("doc_id", F.col("_source").alias("source"), F.col("_lang").alias("lang"), F.col("_topic").alias("topic"), F.col("_tokens").alias("n_tokens"), F.col("_weight").alias("weight"), F.col("_probability").alias("probability"), F.col("_sampled").alias("sampled"))


def sample_to_targets(docs: DataFrame, targets: Mapping[str, Mapping | None] | None = None, keep_share: float = 0.5, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topic: Column | None = None, seed: int = 0, max_local_cells: int = BROADCAST_ROWS) -> DataFrame:
    """The rows of ``docs`` that ``mix_to_targets`` samples, all columns as they are; only the table of cells is joined."""
    rows = docs.select("*", *_cells(docs, source_col, lang_col, text_col, topic))
    return _with_probability(rows, id_col, targets, keep_share, seed, max_local_cells).where("_sampled").select(*docs.columns)


def op4_mix_to_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_to_targets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
