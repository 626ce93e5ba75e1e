"""Text expressions: cleaning, ASCII folding, previews, identities."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Fixed value: the characters taken as Japanese.
JAPANESE = r"[぀-ヿ㐀-鿿]"


@F.pandas_udf(StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def nfkc(text: Column) -> Column:
    """NFKC; pure ASCII does not change and is not sent to Python's normaliser."""
    return F.when(F.length(text) == F.octet_length(text), text).otherwise(_nfkc(text))


def clean_normalised(text: Column) -> Column:
    """The cleaning steps after NFKC, all in the JVM."""
    steps = [
        (r"\r\n?", "\n"),
        (r"[\u00a0\u3000]", " "),
        (r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", ""),
        (r"(?U)(?<=[A-Za-z])-\s*\n\s*(?=[A-Za-z])", ""),
        (r"[ \t]+(?=\n|\z)", ""),
        (r"\n{3,}", "\n\n"),
        (rf"(?<={JAPANESE}) +(?={JAPANESE})", ""),
        (rf"(?<={JAPANESE})\n(?={JAPANESE})", ""),
        (r"(?U)\A\s+|\s+\z", ""),
    ]
    for pattern, by in steps:
        text = F.regexp_replace(text, pattern, by)
    return text


def clean(text: Column) -> Column:
    """Extraction noise taken out: width and control characters, line ends, hyphenation, blank runs, Japanese gaps."""
    return clean_normalised(nfkc(text))


def fold(text: Column) -> Column:
    """A-Z to a-z, nothing else; pure ASCII takes the faster way."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def fold_literal(text: str) -> str:
    return text.translate(str.maketrans(UPPER, LOWER))


def preview(text: Column, chars: int) -> Column:
    """Runs of Unicode white space as one space, trimmed, cut."""
    return F.substring(F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), r"\A | \z", ""), 1, chars)


def content_id(text: Column) -> Column:
    return F.sha2(text, 256)


def work_key(document_id: Column, model: Column, prompt: Column) -> Column:
    return F.sha2(F.concat_ws(":", document_id, model, prompt), 256)
