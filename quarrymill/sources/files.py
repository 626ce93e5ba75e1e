"""Files as a source: recursive listing, digests, text extraction through a plug-in."""

from __future__ import annotations

import email
import email.policy
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The suffixes that are taken.
SUFFIXES = (".pdf", ".doc", ".docx", ".docm", ".xls", ".xlsx", ".xlsm", ".xlsb", ".ppt", ".pptx", ".pptm", ".txt", ".md", ".rtf", ".eml", ".msg")
PLAIN = (".eml", ".txt", ".md")
#: The languages of OCR unless others are asked for.
OCR_LANGUAGES = ("jpn", "en")


@dataclass(frozen=True)
class ExtractionConfig:
    """Passed to the extractor plug-in; the built-in decoders do no OCR."""

    ocr_enabled: bool = True
    ocr_backend: str | None = None
    ocr_languages: tuple[str, ...] = OCR_LANGUAGES
    force_ocr: bool = False

    def __post_init__(self) -> None:
        if self.force_ocr and not self.ocr_enabled:
            raise ValueError("force_ocr needs OCR enabled")


def suffix(path):
    return F.lower(F.regexp_extract(path, r"\.[^./]+$", 0))


def list_files(spark: SparkSession, root: str, suffixes: tuple[str, ...] = SUFFIXES, content: bool = True) -> DataFrame:
    """path, extension, file_size, modified_at, document_id and content of the files under ``root``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return describe(files, suffixes, content)


def describe(files: DataFrame, suffixes: tuple[str, ...] = SUFFIXES, content: bool = True) -> DataFrame:
    """The columns of ``list_files`` for a batch or stream of binary files."""
    bare = F.regexp_replace("path", "^file:(//)?", "")
    out = files.select(bare.alias("path"), suffix(F.col("path")).alias("extension"), F.col("length").alias("file_size"), F.col("modificationTime").alias("modified_at"), F.sha2("content", 256).alias("document_id"), *(["content"] if content else []))
    return out.where(F.col("extension").isin(*suffixes))


def decode(content: bytes, extension: str) -> str:
    """Text of plain files and mails."""
    if extension == ".eml":
        message = email.message_from_bytes(content, policy=email.policy.default)
        body = message.get_body(("plain", "html"))
        return "\n".join(filter(None, (message["subject"], body.get_content() if body else "")))
    if extension in (".txt", ".md"):
        return content.decode("utf-8-sig", "replace")
    raise ValueError(f"no extractor for {extension}")


@dataclass(frozen=True)
class Decoder:
    """The built-in extractor with its options; ``plugin`` (content, extension, options) takes what the decoders do not."""

    config: ExtractionConfig = ExtractionConfig()
    plugin: Callable[[bytes, str, ExtractionConfig], str] | None = None

    def __call__(self, content: bytes, extension: str) -> str:
        if extension in PLAIN and not self.config.force_ocr:
            return decode(content, extension)
        if self.plugin:
            return self.plugin(content, extension, self.config)
        if extension in PLAIN:  # forced, but there is nothing to see in plain text
            return decode(content, extension)
        raise ValueError(f"no extractor for {extension}")


def extract(files: DataFrame, extractor: Callable[[bytes, str], str] = decode) -> DataFrame:
    """``files`` with status (ok or error), extracted_text and error in place of content; a bad file fails alone."""

    @F.pandas_udf("status string, extracted_text string, error string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for content, extension in batches:
            rows = []
            for c, e in zip(content, extension, strict=True):
                try:
                    rows.append(("ok", extractor(c, e), None))
                except Exception as error:  # noqa: BLE001 - any failure of a plug-in is this file's outcome
                    rows.append(("error", None, str(error)[:500]))
            yield pd.DataFrame(rows, columns=["status", "extracted_text", "error"])

    return files.withColumn("x", run("content", "extension")).select(*[c for c in files.columns if c != "content"], "x.*")
