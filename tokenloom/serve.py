"""python -m tokenloom.serve TABLE: search over HTTP.

    GET  /health                          {"status": "ok"}
    GET  /v1/index                        splits, sentences and bytes of the table
    GET  /v1/search?query=&limit=&cursor=&count=
    POST /v1/search                       the same as JSON
    GET  /openapi.json

400 for a request that can't be answered, 502 where Spark fails, 504 where it takes too long, 503 where too many wait.
"""

from __future__ import annotations

import argparse
import json
import threading
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import SparkSession

from .errors import BackendError, InvalidQuery, SearchTimeout
from .operators.search import DEFAULT_LIMIT, MAX_LIMIT, TIMEOUT_S, Searcher, SearchQuery
from .sources.store import Store

MAX_CONCURRENT, MAX_BODY = 16, 1 << 20
_STATUS = ((InvalidQuery, 400), (SearchTimeout, 504), (BackendError, 502))


def request_of(fields: dict) -> SearchQuery:
    """A search from the fields of a request; InvalidQuery if they are of the wrong kind."""
    if unknown := set(fields) - {"query", "limit", "cursor", "count"}:
        raise InvalidQuery(f"unknown fields: {', '.join(sorted(unknown))}")
    query, cursor = fields.get("query"), fields.get("cursor")
    if not isinstance(query, str) or cursor is not None and not isinstance(cursor, str):
        raise InvalidQuery("query and cursor must be text, and query must be there")
    try:
        limit = int(fields.get("limit", DEFAULT_LIMIT))
    except (TypeError, ValueError) as e:
        raise InvalidQuery("limit must be a number") from e
    return SearchQuery(query, limit, cursor, fields.get("count") in (True, "true", "1"))


def openapi() -> dict:
    kinds = {"query": "string", "limit": "integer", "cursor": "string", "count": "boolean"}
    answers = {code: {"description": text} for code, text in (("200", "a page of hits"), ("400", "bad request"), ("502", "Spark failed"), ("503", "busy"), ("504", "too slow"))}
    get = {"parameters": [{"name": n, "in": "query", "required": n == "query", "schema": {"type": k}} for n, k in kinds.items()], "responses": answers}
    post = {"requestBody": {"content": {"application/json": {"schema": {"type": "object", "required": ["query"], "properties": {n: {"type": k} for n, k in kinds.items()}}}}}, "responses": answers}
    one = {"get": {"responses": {"200": {"description": "ok"}}}}
    return {"openapi": "3.0.3", "info": {"title": "tokenloom", "version": "1"}, "paths": {"/health": one, "/v1/index": one, "/v1/search": {"get": get, "post": post}}}


def handler(searcher: Searcher, summary: Callable[[], dict], max_concurrent: int = MAX_CONCURRENT) -> type[BaseHTTPRequestHandler]:
    slots = threading.BoundedSemaphore(max_concurrent)

    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *_) -> None:
            pass

        def answer(self, status: int, body: dict) -> None:
            raw = json.dumps(body).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        def run(self, work: Callable[[], dict]) -> None:
            if not slots.acquire(timeout=searcher.timeout_s):
                return self.answer(503, {"error": "too many searches at once"})
            try:
                status, body = 200, work()
            except tuple(k for k, _ in _STATUS) as e:
                status, body = next(code for kind, code in _STATUS if isinstance(e, kind)), {"error": str(e)}
            finally:
                slots.release()
            self.answer(status, body)

        def do_GET(self) -> None:
            url = urlsplit(self.path)
            if url.path == "/health":
                self.answer(200, {"status": "ok"})
            elif url.path == "/openapi.json":
                self.answer(200, openapi())
            elif url.path == "/v1/index":
                self.run(summary)
            elif url.path == "/v1/search":
                fields = {k: v[-1] for k, v in parse_qs(url.query, keep_blank_values=True).items()}
                self.run(lambda: searcher.search(request_of(fields)).to_dict())
            else:
                self.answer(404, {"error": "no such path"})

        def do_POST(self) -> None:
            size = int(self.headers.get("Content-Length") or 0)
            if urlsplit(self.path).path != "/v1/search":
                return self.answer(404, {"error": "no such path"})
            if size > MAX_BODY:
                return self.answer(400, {"error": "the request is too long"})
            raw = self.rfile.read(size)

            def work() -> dict:
                try:
                    fields = json.loads(raw)
                except ValueError as e:
                    raise InvalidQuery("the body isn't JSON") from e
                if not isinstance(fields, dict):
                    raise InvalidQuery("the body must be an object")
                return searcher.search(request_of(fields)).to_dict()

            self.run(work)

    return Handler


def server(store: Store, host: str = "127.0.0.1", port: int = 0, timeout_s: float = TIMEOUT_S, max_limit: int = MAX_LIMIT, max_concurrent: int = MAX_CONCURRENT) -> ThreadingHTTPServer:
    """A server that is ready to serve_forever(); port 0 takes a free one."""
    def summary() -> dict:
        s = store.summary()
        return {"splits": s.splits, "sentences": s.sentences, "bytes": s.bytes}

    return ThreadingHTTPServer((host, port), handler(Searcher(store.sentences, timeout_s, max_limit), summary, max_concurrent))


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tokenloom.serve", description="Search a sentences table over HTTP.")
    p.add_argument("table")
    p.add_argument("--host", default="127.0.0.1")
    p.add_argument("--port", type=int, default=8080)
    p.add_argument("--timeout", type=float, default=TIMEOUT_S)
    p.add_argument("--max-limit", type=int, default=MAX_LIMIT)
    p.add_argument("--max-concurrent", type=int, default=MAX_CONCURRENT)
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("tokenloom-serve").getOrCreate()
    with server(Store(spark, a.table), a.host, a.port, a.timeout, a.max_limit, a.max_concurrent) as s:
        try:
            s.serve_forever()
        except KeyboardInterrupt:
            pass
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
