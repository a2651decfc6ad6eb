"""Command line and HTTP adapters; thin, over the query functions.

    python -m sidelight.plans.service search INDEX "query" [--top N] [--media]
    python -m sidelight.plans.service serve INDEX [--port N] [--duplicates FILE] [--root DIR ...]
"""

from __future__ import annotations

import argparse
import json
import re
from functools import lru_cache
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import DataFrame, SparkSession

from sidelight.functions.images import EXTENSIONS, clamped, thumbnail
from sidelight.operators import search
from sidelight.operators.index import Embedder, HashingEmbedder, OnnxEmbedder
from sidelight.session import ship
from sidelight.sources.files import Snapshot, newest, read_index

CLI_TOP = 5
NO_INDEX = {"error": "no index yet"}
_PAGE = """<!doctype html><meta charset="utf-8"><title>Search</title>
<form onsubmit="go(event)"><input id="q" autofocus><label><input id="m" type="checkbox">media</label></form><ol id="r"></ol>
<script>async function go(e){e.preventDefault();const u=new URLSearchParams({q:q.value,media:m.checked?1:0});
const d=await(await fetch('/api/search?'+u)).json();r.replaceChildren(...(d.results||[]).map(x=>{const l=document.createElement('li');l.textContent=x.score.toFixed(3)+' '+x.path+' - '+x.description;return l}))}</script>"""


def safe_path(path: str | None, roots: list[str]) -> Path | None:
    """The file itself, if it is an existing file inside one of the roots after links and dots are resolved."""
    if not path:
        return None
    try:
        real = Path(path).resolve(strict=True)
    except (OSError, ValueError, RuntimeError):
        return None
    inside = any(real.is_relative_to(Path(r).resolve()) for r in roots)
    return real if inside and real.is_file() and real.suffix.lower() in EXTENSIONS else None


def load_index(spark: SparkSession, path: str) -> DataFrame:
    return read_index(spark, path) if path.endswith((".jsonl", ".json")) else spark.read.parquet(path)


class Service:
    """Answers over an index, which is kept in memory until its files change."""

    def __init__(self, spark: SparkSession, index: str, embedder: Embedder, duplicates: str | None = None, roots=(), aliases: str | None = None) -> None:
        self.snapshot = Snapshot(spark, index, load_index)
        self.embedder, self.duplicates_file, self.roots = embedder, duplicates, list(roots)
        self.aliases = search.load_aliases(spark, aliases)
        self._thumbs = lru_cache(maxsize=512)(lambda path, mtime, size: thumbnail(Path(path).read_bytes(), size) or Path(path).read_bytes())
        self._vector = lru_cache(maxsize=1024)(lambda q: tuple(embedder.embed([q], "query")[0]))

    def _has_index(self) -> bool:
        return newest(self.snapshot.spark, self.snapshot.path) > 0

    def search(self, query: str, top: int = search.TOP, media: bool = False) -> dict:
        if not self._has_index():
            return NO_INDEX
        sources = (*search.DEFAULT_SOURCES, "media") if media else search.DEFAULT_SOURCES
        index = search.clean(self.snapshot.get())
        total = search.scope_total(index, sources).first()["total"]
        out = {"query": query, "total": total, "results": []}
        if query.strip():
            rows = search.search(index, query, list(self._vector(query)), top, sources, self.aliases).drop("vector", "seq").collect()
            out["results"] = [r.asDict(recursive=True) for r in rows]
        return out

    def stats(self) -> dict:
        if not self._has_index():
            return NO_INDEX
        return search.stats(self.snapshot.get()).first().asDict(recursive=True)

    def duplicates(self) -> dict:
        if not self.duplicates_file or not Path(self.duplicates_file).exists():
            return {"error": "no duplicates report yet"}
        return json.loads(Path(self.duplicates_file).read_text(encoding="utf-8"))

    def thumb(self, path: str | None, size: int = 400) -> bytes | None:
        found = safe_path(path, self.roots)
        return self._thumbs(str(found), found.stat().st_mtime_ns, clamped(size)) if found else None


def handler(service: Service) -> type[BaseHTTPRequestHandler]:
    class Handler(BaseHTTPRequestHandler):
        def _send(self, body: bytes, kind: str, status: int = 200) -> None:
            self.send_response(status)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def do_GET(self) -> None:
            url = urlsplit(self.path)
            args = {k: v[0] for k, v in parse_qs(url.query).items()}

            def number(name: str, default: int) -> int:
                text = args.get(name, "").strip()
                return int(text) if re.fullmatch(r"[+-]?[0-9]{1,9}", text) else default

            if url.path == "/":
                return self._send(_PAGE.encode(), "text/html; charset=utf-8")
            if url.path == "/thumb":
                data = service.thumb(args.get("path"), number("size", 400))
                return self._send(data or b"not found", "image/jpeg" if data else "text/plain", 200 if data else 404)
            routes = {
                "/api/stats": service.stats, "/api/duplicates": service.duplicates,
                "/api/search": lambda: service.search(args.get("q", ""), number("top", search.TOP), args.get("media") == "1"),
            }
            if url.path not in routes:
                return self._send(b"not found", "text/plain", 404)
            self._send(json.dumps(routes[url.path](), ensure_ascii=False).encode(), "application/json; charset=utf-8")

        def log_message(self, *_) -> None:
            pass

    return Handler


def serve(service: Service, port: int) -> ThreadingHTTPServer:
    return ThreadingHTTPServer(("127.0.0.1", port), handler(service))


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    ap.add_argument("what", choices=["search", "serve"])
    ap.add_argument("index")
    ap.add_argument("query", nargs="?", default="")
    ap.add_argument("--top", type=int, default=CLI_TOP)
    ap.add_argument("--media", action="store_true")
    ap.add_argument("--model")
    ap.add_argument("--port", type=int, default=8766)
    ap.add_argument("--duplicates")
    ap.add_argument("--root", action="append", default=[])
    args = ap.parse_args(argv)
    spark = ship(SparkSession.builder.appName("sidelight").getOrCreate())
    if not newest(spark, args.index):
        ap.exit(1, f"{NO_INDEX['error']}: {args.index}\n")
    first = None if args.model else load_index(spark, args.index).select("vector").first()
    width = len(first[0]) if first else 1
    service = Service(spark, args.index, OnnxEmbedder(args.model) if args.model else HashingEmbedder(width), args.duplicates, args.root)
    if args.what == "serve":
        serve(service, args.port).serve_forever()
    found = service.search(args.query, args.top, args.media)
    for rank, r in enumerate(found.get("results", []), 1):
        tag = f" [{r['match_type']}: {r['match_label']}]" if r["match_type"] else ""
        print(f"{rank}. {r['score']:.3f}{tag}  {r['path']}\n   {r['description']}\n   {', '.join(r['keywords'])}")


if __name__ == "__main__":
    main()
