import math
from pathlib import Path

import duckdb
import pytest

from quarrymill.plans import catalogue

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no driver tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cell = lambda v: round(v, 9) if isinstance(v, float) and not math.isnan(v) else v
    return sorted(str([cell(row[i]) for i in order]) for row in rows)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_same_as_sql(spark, duck, name):
    df = catalogue.queries()[name](spark, str(DATA))
    want = duck.sql(catalogue.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert plain([tuple(r) for r in df.collect()], df.columns) == plain(want.fetchall(), want.columns)


@pytest.mark.parametrize("name", ["chunk_stats", "extractive_summary", "embed_chunks", "clean_documents"])
def test_runs(spark, name):
    assert catalogue.queries()[name](spark, str(DATA)).count() > 0


def test_merge_chunks_to_the_end_of_long_texts(spark, tmp_path):
    """Chunks of a text in the target only (500 characters) and of one in the source only (400), past the 400th."""
    rows = [(1, "".join(f"{i:07d}" for i in range(30_000))), (6, "".join(f"{i:08d}" for i in range(25_000)))]
    spark.createDataFrame([(i, t, "en", "src1", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = catalogue.queries()["merge_chunks"](spark, str(tmp_path)).collect()
    ends = sorted(max(r["chunk_index"] for r in got if r["document_id"] == d) for d in {r["document_id"] for r in got})
    assert ends == [210_000 // 500 - 1, 200_000 // 400 - 1] and len(got) == 420 + 500
