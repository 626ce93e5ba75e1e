import random

import pytest
from pyspark.sql import functions as F

from quarrymill.functions.text import clean, fold, preview
from quarrymill.operators.chunking import MAX_CHUNKS, ChunkConfig, chunk_cleaned, chunk_texts, units


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t"))).first()[0]


def test_cleaning_vectors(spark):
    assert one(spark, clean, "ＡＢＣ\r\n改行前のinter-\n national\x00\n\n\n次の段落　") == "ABC\n改行前のinternational\n\n次の段落"
    assert one(spark, clean, "日 本 語\nの本文。\n\n次の段落") == "日本語の本文。\n\n次の段落"
    assert one(spark, clean, "a  \nb\t\nc  ") == "a\nb\nc"
    assert one(spark, clean, None) is None


def test_fold_and_preview(spark):
    assert one(spark, fold, "AbÉ") == "abÉ"
    assert one(spark, lambda c: preview(c, 7), " 　a\n\t b　c d e ") == "a b c d"


def test_chunks_of_four_sentences():
    u = ["第一文です。", "第二文も重要です。", "第三文で詳しく説明します。", "第四文です。"]
    assert chunk_cleaned("".join(u), ChunkConfig(25, 10)) == [u[0] + u[1], u[1] + u[2], u[3]]


def test_long_units_and_lost_white_space():
    assert units("aaaa bbbb, cccc dd", 10) == ["aaaa bbbb,", "cccc dd\n\n"]
    assert units("aaaaabbbbb,ccc", 10) == ["aaaaabbbbb,", "ccc\n\n"]
    assert chunk_cleaned("Hi! You") == ["Hi!You"]


def test_limits(spark):
    texts = spark.createDataFrame([("d", "plain", "あ" * 10_000 + "末尾は対象外です。"), ("e", "plain", ""), ("f", "plain", None)], "document_id string, extractor string, body string")
    rows = chunk_texts(texts).collect()
    assert {r["document_id"] for r in rows} == {"d"}
    assert "末尾" not in "".join(r["content"] for r in rows) and all(r["character_count"] <= 1200 for r in rows)
    assert len(chunk_cleaned("長い文。" * 1000, ChunkConfig(10, 2))) == MAX_CHUNKS


def test_chunk_properties():
    rng = random.Random(3)
    for _ in range(100):
        text = "".join(rng.choice("ab 。!,\n") for _ in range(rng.randrange(400))).strip()
        target = rng.randrange(5, 60)
        config = ChunkConfig(target, rng.randrange(target))
        chunks = chunk_cleaned(text, config)
        assert len(chunks) <= MAX_CHUNKS and all(len(c) <= target + 3 for c in chunks)


def test_config_guards():
    for bad in ((0, 0), (10, 10), (10, -1)):
        with pytest.raises(ValueError):
            ChunkConfig(*bad)
