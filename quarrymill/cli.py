"""Command line: init, scan, refine-keywords, summarize, embed, search, stats, merge."""

from __future__ import annotations

import argparse
import json
import sys
import urllib.request

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quarrymill import process
from quarrymill.operators import embedding, ingest, keywords, merging, search, summaries
from quarrymill.sources import files as source
from quarrymill.sources.files import OCR_LANGUAGES, ExtractionConfig
from quarrymill.store import Store, processing_text, stats


class HttpCompleter:
    """A chat model behind an HTTP endpoint that takes and gives JSON messages."""

    def __init__(self, host: str, model: str, timeout: int = 180, options: dict | None = None, think: bool = False, keep_alive: str = "10m"):
        self.host, self.model, self.timeout, self.options = host.rstrip("/"), model, timeout, options or {}
        self.extra = {"think": think, "keep_alive": keep_alive}

    def complete(self, system: str, user: str) -> str:
        body = {"model": self.model, "stream": False, "options": self.options, **self.extra, "messages": [{"role": "system", "content": system}, {"role": "user", "content": user}]}
        request = urllib.request.Request(f"{self.host}/api/chat", json.dumps(body).encode(), {"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=self.timeout) as reply:
            text = json.load(reply)["message"]["content"].strip()
        if not text:
            raise RuntimeError("the model gave an empty summary")
        return text


def _parallel(command: argparse.ArgumentParser) -> None:
    """Taken so that scripts need no change; Spark deals the work out itself."""
    for name in ("--batch-size", "--workers"):
        command.add_argument(name, type=int, help="has no effect: Spark deals the work out")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="quarrymill")
    top.add_argument("--store", default="store", help="folder of the store")
    commands = top.add_subparsers(dest="command", required=True)
    commands.add_parser("init", help="make or migrate the store")
    scan = commands.add_parser("scan", help="take in the files of a folder")
    scan.add_argument("root")
    _parallel(scan)
    scan.add_argument("--ocr-backend")
    scan.add_argument("--ocr-language", action="append", dest="ocr_languages")
    mode = scan.add_mutually_exclusive_group()
    mode.add_argument("--force-ocr", action="store_true")
    mode.add_argument("--disable-ocr", action="store_true")
    for name in ("refine-keywords", "embed", "summarize"):
        sub = commands.add_parser(name)
        sub.add_argument("--all", action="store_true", help="do finished items again")
        sub.add_argument("--model")
        if name == "embed":
            sub.add_argument("--batch-size", type=int, default=32, help="texts that the encoder gets at once")
        else:
            _parallel(sub)
        if name == "summarize":
            sub.add_argument("--host", default="http://127.0.0.1:11434")
            sub.add_argument("--timeout", type=int, default=180)
            sub.add_argument("--max-output-tokens", type=int, default=512)
            sub.add_argument("--context-window", type=int, default=16384)
            sub.add_argument("--temperature", type=float, default=0.1)
            sub.add_argument("--reduce-group-size", type=int, default=6)
            sub.add_argument("--think", action="store_true", help="let the model think first")
            sub.add_argument("--keep-alive", default="10m", help="how long the host holds the model")
        else:
            sub.add_argument("--device")
    find = commands.add_parser("search")
    find.add_argument("query")
    find.add_argument("--mode", choices=("keyword", "vector", "hybrid"), default="keyword")
    find.add_argument("--path")
    find.add_argument("--directory")
    find.add_argument("--extension")
    find.add_argument("--operator", choices=("and", "or"), default="and")
    find.add_argument("--model", help="model of the keywords and vectors to search")
    find.add_argument("--device")
    find.add_argument("--top-k", type=int, default=10)
    serve = commands.add_parser("serve", help="JSON search over HTTP")
    serve.add_argument("--host", default="127.0.0.1")
    serve.add_argument("--port", type=int, default=8000)
    serve.add_argument("--model")
    serve.add_argument("--device")
    serve.add_argument("--preview-chars", type=int, default=240)
    commands.add_parser("stats")
    merge = commands.add_parser("merge")
    merge.add_argument("sources", nargs="+")
    return top


def run_search(store: Store, text: str, mode: str, top_k: int, preview_chars: int = 160, encode=None, model: str | None = None, device: str | None = None, **options):
    """A search; ``model`` names both the refined keywords and the vectors, which have defaults of their own."""
    config, tables = embedding.EmbeddingConfig(device=device), store.tables()
    vectors = tables["embeddings"].where(F.col("model_name") == (model or config.model_name))
    options["model_name"] = model or keywords.REFINED_MODEL
    return search.search(processing_text(tables["texts"]), tables["paths"], tables["keywords"], vectors, text, mode, encode or embedding.HashedEncoder().encode, top_k, preview_chars, **options)


def _vectors(model: str | None, batch_size: int, device: str | None) -> embedding.EmbeddingConfig:
    return embedding.EmbeddingConfig(model or embedding.EmbeddingConfig.model_name, batch_size=batch_size, device=device)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    top = parser()
    args = top.parse_args(argv)
    spark = spark or SparkSession.builder.appName("quarrymill").getOrCreate()
    store = Store(spark, args.store)
    try:
        return _run(args, store)
    except (OSError, RuntimeError, ValueError) as error:
        top.error(str(error))


def _run(args: argparse.Namespace, store: Store) -> int:
    if args.command not in ("search", "stats", "serve") or not store.exists():
        store.init()
    if args.command == "scan":
        config = ExtractionConfig(not args.disable_ocr, args.ocr_backend, tuple(args.ocr_languages or OCR_LANGUAGES), args.force_ocr)
        counts = {r["outcome"]: r["n"] for r in ingest.scan(store, args.root, source.Decoder(config), postprocess=process.postprocess, summary_model=summaries.PROVISIONAL_MODEL).collect()}
        print(*(f"{k}={counts.get(k, 0)}" for k in ("extracted", "skipped", "failed")))
        return int(counts.get("failed", 0) > 0)
    if args.command == "refine-keywords":
        config = keywords.KeywordConfig(args.model or keywords.REFINED_MODEL)
        _vectors(None, 32, args.device)  # the device is checked as for vectors; the built-in encoder has none
        print(process.refine(store, lambda: keywords.RefinedExtractor(embedding.HashedEncoder().encode, config), config, args.all))
    elif args.command == "embed":
        print(f"embedded={process.embed(store, embedding.HashedEncoder, _vectors(args.model, args.batch_size, args.device), args.all)}")
    elif args.command == "summarize":
        model = args.model or "default"
        config = summaries.SummaryConfig(model, args.host, group_size=args.reduce_group_size)
        options = {"num_predict": args.max_output_tokens, "num_ctx": args.context_window, "temperature": args.temperature}
        counts = process.summarize(store, lambda: HttpCompleter(args.host, model, args.timeout, options, args.think, args.keep_alive), config, args.all)
        print(counts)
        return int(counts["failed"] > 0)
    elif args.command == "search":
        for rank, hit in enumerate(run_search(store, args.query, args.mode, args.top_k, model=args.model, device=args.device, path_filter=args.path, directory=args.directory, extension=args.extension, operator=args.operator).collect(), 1):
            print(rank, hit["path"], hit["preview"], sep="\t")
    elif args.command == "serve":
        from quarrymill.server import serve

        serve(store, args.host, args.port, args.preview_chars, args.model, args.device)
    elif args.command == "stats":
        print(*(f"{r['name']}={r['n']}" for r in stats(store.tables()).collect()))
    elif args.command == "merge":
        print(f"merged={merging.merge_stores(store, [Store(store.spark, p) for p in args.sources])}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
