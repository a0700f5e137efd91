"""The engine behind HTTP: a handler of requests without a framework, and a small server for it."""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import Any

from lodestar.engine import Engine
from lodestar.operators.answers import rule_answers
from lodestar.plans.lineage import owned

#: Formats that can be ingested.
FORMATS = ("txt", "md")


def _ingest(engine: Engine, body: Any) -> tuple[int, dict[str, Any]]:
    docs = body.get("documents") if isinstance(body, dict) else None
    if not isinstance(docs, list) or not docs:
        return 422, {"detail": "documents must be a list of name and text"}
    if any(not isinstance(d, dict) or not isinstance(d.get("name"), str) or not isinstance(d.get("text"), str) for d in docs):
        return 422, {"detail": "a document needs a name and a text"}
    odd = [d["name"] for d in docs if d["name"].rpartition(".")[2].lower() not in FORMATS]
    if odd:
        return 400, {"detail": f"not a known format: {odd[0]}"}
    rows = engine.spark.createDataFrame([(d["name"].rpartition(".")[0], d["text"]) for d in docs], "doc_id string, text string")
    try:
        return 200, {"chunks": engine.ingest(rows)}
    except ValueError as e:
        return 422, {"detail": str(e)}


def _query(engine: Engine, body: Any) -> tuple[int, dict[str, Any]]:
    asked = body.get("question") if isinstance(body, dict) else None
    k = body.get("k", 2) if isinstance(body, dict) else 2
    if not isinstance(asked, str) or not asked.strip() or not isinstance(k, int) or not 1 <= k <= 100:
        return 422, {"detail": "a question must be a text, and k a number from 1 to 100"}
    question = engine.spark.createDataFrame([(1, asked)], "qid long, question string")
    try:
        with owned():  # tables of a request go with it
            found = engine.query(question, k)
            rows = found.orderBy("rank").collect()  # k rows
            # the answer is made of what is ranked already
            answer = rule_answers(question, engine.spark.createDataFrame(rows, found.schema)).first()["answer"]
    except LookupError as e:
        return 404, {"detail": str(e)}
    names = ("rank", "chunk_id", "doc_name", "page_num", "text", "score", "mode")
    return 200, {"answer": answer, "results": [{c: r[c] for c in names} for r in rows]}


def handle(engine: Engine, method: str, path: str, body: bytes = b"") -> tuple[int, dict[str, Any]]:
    """(status, document) of a request: GET /health, POST /ingest, POST /query.

    400 is a format that cannot be read, 404 an unknown path or a store without
    documents, 405 another method, 422 a body that says nothing usable.
    """
    routes = {"/health": ("GET", lambda _: (200, engine.health())), "/ingest": ("POST", lambda b: _ingest(engine, b)), "/query": ("POST", lambda b: _query(engine, b))}
    if path not in routes:
        return 404, {"detail": "no such path"}
    wanted, run = routes[path]
    if method != wanted:
        return 405, {"detail": f"use {wanted}"}
    try:
        document = json.loads(body) if body else None
    except ValueError:
        return 422, {"detail": "the body is not JSON"}
    return run(document)


def serve(engine: Engine, host: str = "127.0.0.1", port: int = 8000) -> ThreadingHTTPServer:
    """A server of ``handle``; the caller runs ``serve_forever``."""

    class Handler(BaseHTTPRequestHandler):
        def _answer(self) -> None:
            size = int(self.headers.get("Content-Length") or 0)
            status, document = handle(engine, self.command, self.path, self.rfile.read(size))
            content = json.dumps(document, ensure_ascii=False).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json; charset=utf-8")
            self.send_header("Content-Length", str(len(content)))
            self.end_headers()
            self.wfile.write(content)

        do_GET = do_POST = _answer  # noqa: N815  the names that the server calls

        def log_message(self, *args: object) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
