import json
from pathlib import Path

import pytest

from quarrymill import process
from quarrymill.cli import main
from quarrymill.operators import ingest, merging
from quarrymill.operators.embedding import HashedEncoder
from quarrymill.operators.summaries import PROVISIONAL_MODEL, SummaryConfig, extractive, map_reduce_summaries, reduce_calls, replace_provisional
from quarrymill.server import answer
from quarrymill.store import Store, duplicates, stats
from quarrymill.schema import SCHEMAS


def scan(store, root, **options):
    rows = ingest.scan(store, str(root), postprocess=process.postprocess, summary_model=PROVISIONAL_MODEL, **options).collect()
    return {r["outcome"]: r["n"] for r in rows}


def write(folder, **files):
    folder.mkdir(exist_ok=True)
    for name, text in files.items():
        (folder / f"{name}.txt").write_text(text)


def test_scan_life_cycle(spark, tmp_path):
    root, store = tmp_path / "docs", Store(spark, str(tmp_path / "store"))
    write(root, a="Alpha engines run queries. 第一文です。", b="Beta document", c="Beta document")
    write(tmp_path / "docs-other", z="Other words")
    store.init()
    assert scan(store, root) == {"extracted": 3}
    assert scan(store, root) == {"skipped": 3}
    n = {r["name"]: r["n"] for r in stats(store.tables()).collect()}
    assert n["documents"] == 2 and n["paths"] == 3 and n["texts"] == 2 and n["summaries"] == 2
    assert scan(store, tmp_path / "docs-other") == {"extracted": 1}

    def broken(content, extension):
        if b"Bad" in content:
            raise OSError("unreadable")
        return content.decode()

    write(root, a="Changed bytes", bad="Bad file")
    (root / "b.txt").unlink()
    assert scan(store, root, extractor=broken) == {"extracted": 1, "failed": 1, "skipped": 1}
    tables = store.tables()
    assert {r["path"].rsplit("/", 2)[-2] + "/" + r["path"].rsplit("/", 1)[-1] for r in tables["paths"].collect()} == {"docs/a.txt", "docs/bad.txt", "docs/c.txt", "docs-other/z.txt"}
    assert {r["extracted_text"] for r in tables["texts"].collect()} == {"Changed bytes", "Beta document", "Other words"}
    for name in SCHEMAS:
        assert duplicates(tables[name], name).count() == 0, name

    assert store.read("documents").where("status = 'failed'").count() == 1

    assert process.embed(store, HashedEncoder) > 0 and process.embed(store, HashedEncoder) == 0
    status, found = answer(store, "/api/search/keyword?q=%20beta")
    assert status == 200 and (found["query"], found["mode"]) == ("beta", "keyword") and [h["path"].rsplit("/", 1)[-1] for h in found["results"]] == ["c.txt"]
    assert answer(store, "/api/search/hybrid?q=Beta%20document&top_k=1")[1]["results"][0]["path"].endswith("c.txt")
    assert [answer(store, u)[0] for u in ("/api/search/odd?q=a", "/api/search/keyword?q=%20", "/api/search/keyword?q=%22", "/api/search/keyword?q=a&top_k=101")] == [404, 422, 503, 422]


def test_merge_is_idempotent(spark, tmp_path, capsys):
    stores = []
    for name in ("left", "right"):
        write(tmp_path / name, shared="The same text", own=f"Text of {name}")
        stores.append(Store(spark, str(tmp_path / f"{name}.store")))
        stores[-1].init()
        scan(stores[-1], tmp_path / name)
    assert merging.merge_stores(stores[0], [stores[1]]) == 2
    before = {r["name"]: r["n"] for r in stats(stores[0].tables()).collect()}
    assert before["documents"] == 3 and before["texts"] == 3 and before["paths"] == 4 and before["summaries"] == 3
    assert merging.merge_stores(stores[0], [stores[1], stores[0]]) == 2
    assert {r["name"]: r["n"] for r in stats(stores[0].tables()).collect()} == before
    with pytest.raises(FileNotFoundError):
        merging.merge_stores(stores[0], [Store(spark, str(tmp_path / "none"))])
    assert main(["--store", stores[0].path, "stats"], spark) == 0 and "documents=3" in capsys.readouterr().out
    assert main(["--store", stores[0].path, "search", "left"], spark) == 0 and "own.txt" in capsys.readouterr().out


def test_summaries(spark):
    assert extractive("一つ目の文です。二つ目の文です。", [], 400) == "一つ目の文です。二つ目の文です。"
    got = extractive("無関係な文です。" * 3 + "重要な検索の話です。" + "別の長い話が続きます。" * 3, [("検索", 1.0)], 20)
    assert "重要な検索の話です。" in got and len(got) <= 20
    assert [reduce_calls(n) for n in (1, 6, 7, 50)] == [1, 7, 10, 62]

    class Numbered:
        def complete(self, system, user):
            if "BOOM" in user:
                raise RuntimeError("no")
            return "s" + str(len(user) % 7)

    rows = [("a", "x", i, f"part {i}") for i in range(8)] + [("b", "x", 0, "only")] + [("c", "x", 0, "BOOM"), ("c", "x", 1, "fine")]
    chunks = spark.createDataFrame(rows, "document_id string, extractor string, chunk_index int, content string")
    done = {r["document_id"]: r for r in map_reduce_summaries(chunks, Numbered, SummaryConfig()).collect()}
    assert done["a"]["summary"] and done["b"]["summary"] == Numbered().complete("", SummaryConfig().map_prompt + "only")
    assert done["c"]["summary"] is None
    old = spark.createDataFrame([("a", "x", "extractive-ja-v1", "local", "v", "old", None), ("a", "x", "llm", "h", "p", "kept", "k")], SCHEMAS["summaries"])
    new = spark.createDataFrame([("a", "x", PROVISIONAL_MODEL, "local", "v2", "new", "w")], SCHEMAS["summaries"])
    assert {r["summary"] for r in replace_provisional(old, new).collect()} == {"kept", "new"}


def test_older_snapshots_are_filled_in(spark, tmp_path):
    store = Store(spark, str(tmp_path / "old"))
    store.init()
    store.commit({"texts": spark.createDataFrame([("d", "x", "ａ  \nb", None, None, None)], SCHEMAS["texts"]), "chunks": spark.createDataFrame([("d", "x", 0, "c", "h", 1, "v")], SCHEMAS["chunks"])})
    store.init()
    row = store.read("texts").first()
    assert row["cleaned_text"] == "a\nb" and len(row["content_hash"]) == 64 and store.read("chunks").count() == 0
    assert json.loads(json.dumps(row["document_id"])) == "d"


def files(store):
    return sorted(str(p) for p in Path(store.path).rglob("*.parquet"))


def test_commits_are_whole_and_reads_write_nothing(spark, tmp_path, capsys):
    store = Store(spark, str(tmp_path / "s"))
    store.init()
    write(tmp_path / "docs", a="Some words here", b="Other words there")
    assert scan(store, tmp_path / "docs") == {"extracted": 2}
    before, manifests = files(store), sorted(Path(store.path).glob("MANIFEST.*"))
    for command in (["stats"], ["search", "words"], ["init"]):
        assert main(["--store", store.path, *command], spark) == 0
    assert files(store) == before and sorted(Path(store.path).glob("MANIFEST.*")) == manifests
    assert "documents=2" in capsys.readouterr().out
    # a writer that stops before its last line leaves what was there, and the next commit goes on from that
    (Path(store.path) / "MANIFEST.99").write_text("documents\tnowhere")
    again = Store(spark, store.path)
    assert again.exists() and again.read("documents").count() == 2
    assert scan(again, tmp_path / "docs") == {"skipped": 2}
    assert (Path(store.path) / "MANIFEST.100").exists() and store.read("paths").count() == 2


def test_writers_do_not_lose_updates(spark, tmp_path):
    one, two = (Store(spark, str(tmp_path / "s")) for _ in range(2))
    one.init()
    row = lambda k: spark.createDataFrame([(k, ".txt", "extracted")], SCHEMAS["documents"])
    mine, theirs = one.read("documents"), two.read("documents")
    one.commit({"documents": mine.unionByName(row("a"))})
    with pytest.raises(RuntimeError):
        two.commit({"documents": theirs.unionByName(row("b"))})
    two.commit({"documents": two.read("documents").unionByName(row("b"))})
    assert {r["document_id"] for r in one.read("documents").collect()} == {"a", "b"}
    for k in range(5):  # old snapshots go
        one.commit({"documents": one.read("documents").unionByName(row(f"c{k}"))})
    assert len(list((tmp_path / "s").glob("MANIFEST.*"))) == 2 and len(list((tmp_path / "s" / "documents").iterdir())) == 2
    assert one.read("documents").count() == 7


def test_merge_skips_itself_by_place(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.init()
    assert merging.merge_stores(store, [Store(spark, f"{tmp_path}/x/../s"), Store(spark, f"file://{tmp_path}/s")]) == 0


def test_file_changed_during_scan(spark, tmp_path, monkeypatch):
    from quarrymill.operators import ingest as module

    write(tmp_path / "docs", a="First words")
    listed = module.source.list_files

    def changing(session, root, **options):
        out = listed(session, root, **options)
        if options.get("content", True):
            (tmp_path / "docs" / "a.txt").write_text("Second words")
            return listed(session, root, **options)
        return session.createDataFrame(out.collect(), out.schema)

    monkeypatch.setattr(module.source, "list_files", changing)
    store = Store(spark, str(tmp_path / "s"))
    store.init()
    assert scan(store, tmp_path / "docs") == {"failed": 1}
    monkeypatch.undo()
    assert scan(store, tmp_path / "docs") == {"extracted": 1} and store.read("texts").first()["extracted_text"] == "Second words"


def test_models_of_keywords_and_vectors(spark, tmp_path, capsys):
    store = Store(spark, str(tmp_path / "s"))
    write(tmp_path / "docs", a="Granite quarry engines", b="Paper mills and rivers")
    run = lambda *a: main(["--store", store.path, *a], spark)
    assert run("scan", str(tmp_path / "docs"), "--ocr-language", "en", "--workers", "2") == 0
    assert run("embed", "--model", "other") == 0 and run("refine-keywords", "--model", "other") == 0
    assert {r["model_name"] for r in store.read("embeddings").collect()} == {"other"}
    capsys.readouterr()
    assert run("search", "--mode", "vector", "--model", "other", "granite quarry") == 0 and capsys.readouterr().out.splitlines()[0].split("\t")[1].endswith("a.txt")
    assert run("search", "--mode", "vector", "granite") == 0 and capsys.readouterr().out == ""
    with pytest.raises(SystemExit):
        run("embed", "--device", "tpu")


def test_options_reach_the_extractor():
    from quarrymill.sources.files import Decoder, ExtractionConfig

    seen = []
    plugin = lambda content, extension, config: seen.append(config) or "scanned"
    decoder = Decoder(ExtractionConfig(ocr_languages=("de",), force_ocr=True), plugin)
    assert decoder(b"x", ".pdf") == "scanned" and decoder(b"x", ".txt") == "scanned" and seen[0].ocr_languages == ("de",)
    assert Decoder()(b"plain", ".txt") == "plain"
    with pytest.raises(ValueError):
        Decoder()(b"x", ".pdf")
