"""A store: Parquet snapshots of its tables and numbered manifests that name them."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.functions.text import clean, content_id, work_key
from quarrymill.schema import KEYS, SCHEMAS

Tables = dict[str, DataFrame]
#: Commits of which the snapshots stay, so that those who read the one before the newest can go on.
KEEP = 2


class Store:
    """Tables under a path of any file system that Spark reads; readers see whole commits only."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._staged: dict[int, tuple[DataFrame, str]] = {}
        self._seen: dict[str, str | None] = {}
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _versions(self) -> list[int]:
        """Numbers of the manifests there are, whole or not, the newest first."""
        here = self._path(self.path)
        names = [f.getPath().getName() for f in self._fs.listStatus(here)] if self._fs.exists(here) else []
        return sorted((int(n.removeprefix("MANIFEST.")) for n in names if n.startswith("MANIFEST.") and n[9:].isdigit()), reverse=True)

    def _lines(self, version: int) -> dict[str, str] | None:
        """A manifest; None if its writer stopped before the last line."""
        rows = self.spark.read.text(f"{self.path}/MANIFEST.{version}", wholetext=True).collect()
        lines = rows[0][0].splitlines() if rows else []
        return dict(line.split("\t") for line in lines[:-1]) if lines[-1:] == ["end"] else None

    def _manifest(self) -> dict[str, str]:
        """The newest whole manifest."""
        return next(filter(lambda m: m is not None, map(self._lines, self._versions())), {})

    def exists(self) -> bool:
        return bool(self._manifest())

    def read(self, name: str) -> DataFrame:
        """The table with all columns of its schema; columns that an older snapshot lacks are null."""
        return self._read(name, self._manifest())

    def _read(self, name: str, manifest: dict[str, str]) -> DataFrame:
        where = self._seen[name] = manifest.get(name)
        return self.spark.createDataFrame([], SCHEMAS[name]) if where is None else self._at(name, where)

    def tables(self) -> Tables:
        """All tables as of one commit."""
        manifest = self._manifest()
        return {name: self._read(name, manifest) for name in SCHEMAS}

    def _at(self, name: str, where: str) -> DataFrame:
        df = self.spark.read.option("mergeSchema", True).parquet(f"{self.path}/{where}")
        wanted = self._schema(name)
        return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted])

    def _schema(self, name: str):
        return self.spark.createDataFrame([], SCHEMAS[name]).schema

    def stage(self, name: str, df: DataFrame) -> DataFrame:
        """Write a snapshot that the next commit may point to, and go on from its files: plans stay short."""
        where = f"{name}/{uuid.uuid4().hex}"
        df.select(*self._schema(name).names).write.parquet(f"{self.path}/{where}")
        staged = self._at(name, where)
        self._staged[id(staged)] = (staged, where)
        return staged

    def commit(self, tables: Tables) -> None:
        """Point to snapshots of the given tables, written unless staged already; the others stay.

        A commit is one new numbered manifest, made only if no other has its number, so a stop at any time leaves the
        commit before it. A table that another writer has replaced since it was read here is an error.
        """
        names = {name: self._staged[id(df)][1] if id(df) in self._staged else self._staged[id(self.stage(name, df))][1] for name, df in tables.items()}
        versions, manifest = self._versions(), self._manifest()
        lost = [name for name in names if name in self._seen and manifest.get(name) != self._seen[name]]
        if lost:
            for _, where in self._staged.values():
                self._fs.delete(self._path(f"{self.path}/{where}"), True)
            self._staged.clear()
            raise RuntimeError(f"another writer has committed since {', '.join(lost)} were read")
        text = "\n".join([*(f"{k}\t{v}" for k, v in sorted((manifest | names).items())), "end"])
        out = self._fs.create(self._path(f"{self.path}/MANIFEST.{versions[0] + 1 if versions else 1}"), False)
        out.write(bytearray(text.encode()))
        out.close()
        self._seen |= names
        self._staged.clear()
        self._collect()

    def _collect(self) -> None:
        """Remove manifests older than the ``KEEP`` newest whole ones, and the snapshots that only they name."""
        known = [(v, self._lines(v)) for v in self._versions()]
        whole = [v for v, m in known if m is not None][:KEEP]
        kept = {where for v, m in known if v >= whole[-1] and m for where in m.values()}
        for v, m in known:
            if v < whole[-1]:
                for where in set((m or {}).values()) - kept:
                    self._fs.delete(self._path(f"{self.path}/{where}"), True)
                self._fs.delete(self._path(f"{self.path}/MANIFEST.{v}"), False)

    def init(self) -> None:
        """Make missing tables and fill columns that older snapshots lack; derivatives of texts that cleaning changes go.

        A store that lacks nothing is left as it is.
        """
        if not self.exists():
            self.commit({name: self.spark.createDataFrame([], schema) for name, schema in SCHEMAS.items()})
            return
        tables = self.tables()
        bare = tables["texts"].where("cleaned_text is null or content_hash is null").isEmpty()
        if bare and tables["summaries"].where("work_key is null").isEmpty():
            return
        texts, changed = backfill_texts(tables["texts"])
        stale = changed.select("document_id", "extractor")
        done = {"texts": texts, "summaries": backfill_summaries(tables["summaries"]).join(stale, ["document_id", "extractor"], "left_anti")}
        for name in ("chunks", "keywords", "embeddings"):
            done[name] = tables[name].join(stale, ["document_id", "extractor"], "left_anti")
        self.commit(done)

    def resolved(self) -> str:
        """The store's place, the same however it is written."""
        full = self._fs.makeQualified(self._path(self.path)).toUri()
        return os.path.realpath(full.getPath()) if full.getScheme() == "file" else full.normalize().toString()


def backfill_texts(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Texts with cleaned_text and content_hash filled in, and those of them whose cleaning changed the text."""
    missing = F.col("cleaned_text").isNull()
    cleaned = clean(F.col("extracted_text"))
    changed = texts.where(missing & (cleaned != F.col("extracted_text")))
    full = texts.withColumns({"content_hash": F.coalesce("content_hash", content_id(F.col("extracted_text"))), "cleaned_text": F.coalesce("cleaned_text", cleaned)})
    return full, changed


def backfill_summaries(summaries: DataFrame) -> DataFrame:
    return summaries.withColumn("work_key", F.coalesce("work_key", work_key(F.col("document_id"), F.col("model_name"), F.col("prompt_version"))))


def stats(tables: Tables) -> DataFrame:
    """(name, n): rows of each table."""
    counts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n") for name, df in tables.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


def duplicates(df: DataFrame, name: str) -> DataFrame:
    """Keys of a table that are not unique; empty for a sound one."""
    return df.groupBy(*KEYS[name]).count().where("count > 1")


def processing_text(texts: DataFrame) -> DataFrame:
    """document_id, extractor, body: the cleaned text, or the extracted one where that is null."""
    return texts.select("document_id", "extractor", F.coalesce("cleaned_text", "extracted_text").alias("body"))
