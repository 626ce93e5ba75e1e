"""JSON search over HTTP: GET /api/search/{mode}?q=...&top_k=..."""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from quarrymill.cli import run_search
from quarrymill.store import Store


def answer(store: Store, url: str, preview_chars: int = 240, encode=None, model: str | None = None, device: str | None = None) -> tuple[int, dict]:
    """(HTTP status, JSON object) for a request: query, mode and results, or detail of what is wrong."""
    parts = urlsplit(url)
    mode = parts.path.removeprefix("/api/search/")
    if not parts.path.startswith("/api/search/") or mode not in ("keyword", "vector", "hybrid"):
        return 404, {"detail": "no such search mode"}
    given = {k: v[-1] for k, v in parse_qs(parts.query, keep_blank_values=True).items()}
    if not given.get("q", "").strip():
        return 422, {"detail": "q is blank"}
    try:
        top_k = int(given.get("top_k", 10))
    except ValueError:
        return 422, {"detail": "top_k is not a number"}
    operator = given.get("operator", "and")
    if not 1 <= top_k <= 100 or operator not in ("and", "or"):
        return 422, {"detail": "top_k is 1 to 100, operator and/or"}
    try:
        hits = run_search(store, given["q"], mode, top_k, preview_chars, encode, model, device, operator=operator, path_filter=given.get("path"), directory=given.get("directory"), extension=given.get("extension"))
        return 200, {"query": given["q"].strip(), "mode": mode, "results": [json.loads(x) for x in hits.toJSON().collect()]}
    except (RuntimeError, ValueError) as error:
        return 503, {"detail": str(error)}


def serve(store: Store, host: str = "127.0.0.1", port: int = 8000, preview_chars: int = 240, model: str | None = None, device: str | None = None) -> None:
    """Answer requests until stopped."""
    if not 1 <= port <= 65535 or preview_chars <= 0:
        raise ValueError("port is 1 to 65535, preview_chars above 0")

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:
            status, value = answer(store, self.path, preview_chars, None, model, device)
            body = json.dumps(value, ensure_ascii=False).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json; charset=utf-8")
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

    ThreadingHTTPServer((host, port), Handler).serve_forever()
