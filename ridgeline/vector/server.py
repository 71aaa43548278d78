"""The session over HTTP: JSON requests, Arrow IPC streams as results. For trusted networks: there is no log-in."""

from __future__ import annotations

import fnmatch
import json
import re
from collections.abc import Callable, Sequence
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import Any
from urllib.parse import unquote

import pyarrow as pa

from ridgeline.vector import errors
from ridgeline.vector.config import IVF, WriteOptions
from ridgeline.vector.query import VectorQuery
from ridgeline.vector.session import Results, Session

STATUS = {errors.NotFound: 404, errors.AlreadyExists: 409, errors.Conflict: 409, errors.Busy: 429, errors.InvalidArgument: 400, errors.InvalidSchema: 400}
_TABLE = r"/v1/table/(?P<table>[^/]+)"
_INDEX = _TABLE + r"/index/(?P<index>[^/]+)"


def query_to_json(q: VectorQuery) -> dict[str, Any]:
    parts = {name: q.part(name) for name in ("select", "limit", "nprobes", "where", "exact")}
    return {"vector": list(q.vector), "column": q.column, "index": q.index, **parts}


def query_of_json(table: str, doc: dict[str, Any]) -> VectorQuery:
    """The same checks as those of the query's own methods; unknown fields are refused."""
    known = {"vector", "column", "index", "select", "limit", "nprobes", "where", "exact"}
    if not isinstance(doc, dict) or doc.keys() - known or not isinstance(doc.get("vector"), list):
        raise errors.InvalidArgument("a query has a vector and known fields only")
    q = VectorQuery(table, tuple(float(x) for x in doc["vector"]), doc.get("column"), doc.get("index"))
    q = q.limit(doc["limit"]) if doc.get("limit") is not None else q
    q = q.nprobes(doc["nprobes"]) if doc.get("nprobes") is not None else q
    q = q.where(doc["where"]) if doc.get("where") is not None else q
    q = q.select(doc["select"]) if doc.get("select") is not None else q
    return q.bypass_vector_index() if doc.get("exact") else q


class Service:
    """Routes to session calls. ``sources``: patterns of the paths that may be registered; none allows nothing."""

    def __init__(self, session: Session, sources: Sequence[str] = ()):
        self.session, self.sources = session, list(sources)
        self.routes: list[tuple[str, re.Pattern, Callable[..., Any]]] = [
            (m, re.compile(p + "$"), f)
            for m, p, f in (
                ("GET", "/health", self.health), ("GET", r"/openapi\.json", self.openapi), ("GET", "/v1/table", self.tables), ("POST", "/v1/sql", self.sql), ("POST", "/v1/sql/explain", self.sql_explain),
                ("POST", _INDEX + "/register", self.index_register), ("GET", _INDEX + "/stats", self.index_stats), ("POST", _INDEX + "/refresh", self.index_refresh), ("POST", _INDEX + "/drop", self.index_drop), ("GET", _TABLE + "/index/list", self.index_list),
                ("POST", _TABLE + "/register", self.register), ("GET", _TABLE + "/describe", self.describe), ("POST", _TABLE + "/query", self.query), ("POST", _TABLE + "/explain", self.explain), ("POST", _TABLE + "/to_sql", self.to_sql),
                ("POST", _TABLE + "/deregister", self.deregister), ("POST", _TABLE + "/create_index", self.create_index),
            )
        ]

    def health(self, _: dict) -> dict:
        return {"status": "ok"}

    def openapi(self, _: dict) -> dict:
        paths: dict[str, dict] = {}
        for method, pattern, f in self.routes:
            path = re.sub(r"\(\?P<(\w+)>[^)]*\)", r"{\1}", pattern.pattern.rstrip("$").replace("\\", ""))
            paths.setdefault(path, {})[method.lower()] = {"operationId": f.__name__, "responses": {"200": {"description": "done"}}}
        return {"openapi": "3.1.0", "info": {"title": "ridgeline", "version": "1"}, "paths": paths}

    def tables(self, _: dict) -> dict:
        return {"tables": self.session.list_tables()}

    def register(self, doc: dict, table: str) -> dict:
        path = str(doc.get("path", ""))
        if ".." in path.split("/") or not any(fnmatch.fnmatchcase(path, p) for p in self.sources):
            raise errors.InvalidArgument("this path may not be registered")
        self.session.register_parquet(table, path)
        return {"table": table}

    def describe(self, _: dict, table: str) -> dict:
        return {"table": table, "columns": [{"name": f.name, "type": f.dataType.simpleString()} for f in self.session.table(table).df.schema.fields]}

    def deregister(self, _: dict, table: str) -> dict:
        self.session.deregister_table(table)
        return {}

    def query(self, doc: dict, table: str) -> Results:
        return self.session.results(query_of_json(table, doc))

    def explain(self, doc: dict, table: str) -> dict:
        return {"plan": self.session.explain(query_of_json(table, doc))}

    def to_sql(self, doc: dict, table: str) -> dict:
        return {"sql": self.session.to_sql(query_of_json(table, doc))}

    def sql(self, doc: dict) -> Results:
        return self.session.results(str(doc.get("sql", "")))

    def sql_explain(self, doc: dict) -> dict:
        return {"plan": self.session.explain(str(doc.get("sql", "")))}

    def create_index(self, doc: dict, table: str) -> dict:
        try:
            config = IVF(**doc["config"])
            options = WriteOptions(**doc.get("options", {}))
            name, column, keys = doc["name"], doc["column"], doc["keys"]
        except (KeyError, TypeError) as e:
            raise errors.InvalidArgument(f"the request lacks or does not know a field: {e}") from None
        self.session.table(table).create_index(name, column, keys, config, options, wait=bool(doc.get("wait", False)))
        return self.index_stats({}, table, name)

    def index_refresh(self, doc: dict, table: str, index: str) -> dict:
        self.session.table(table).refresh_index(index, IVF(**doc["config"]) if doc.get("config") else None, wait=bool(doc.get("wait", False)))
        return self.index_stats({}, table, index)

    def index_register(self, doc: dict, table: str, index: str) -> dict:
        self.session.table(table).register_index(index, str(doc.get("metadata_location", "")))
        return self.index_stats({}, table, index)

    def index_stats(self, _: dict, table: str, index: str) -> dict:
        s = self.session.table(table).index_status(index)
        return s | {"error": None if s["error"] is None else str(s["error"])[:500]}

    def index_list(self, _: dict, table: str) -> dict:
        return {"indexes": self.session.table(table).list_indexes()}

    def index_drop(self, _: dict, table: str, index: str) -> dict:
        self.session.table(table).drop_index(index)
        return {}

    def answer(self, method: str, path: str, body: bytes) -> tuple[int, str, bytes | Results]:
        for m, pattern, call in self.routes:
            if m == method and (found := pattern.match(path.split("?")[0])):
                try:
                    doc = json.loads(body) if body else {}
                    out = call(doc, **{k: unquote(v) for k, v in found.groupdict().items()})
                    return (200, "application/vnd.apache.arrow.stream", out) if isinstance(out, Results) else (200, "application/json", json.dumps(out).encode())
                except ValueError as e:
                    return 400, "application/json", json.dumps({"error": "InvalidArgument", "message": str(e)}).encode()
                except errors.EngineError as e:
                    return STATUS.get(type(e), 500), "application/json", json.dumps({"error": type(e).__name__, "message": str(e)}).encode()
                except Exception as e:  # noqa: BLE001
                    return 500, "application/json", json.dumps({"error": "Backend", "message": str(e)[:500]}).encode()
        return 404, "application/json", b'{"error": "NotFound", "message": "no such route"}'


def serve(session: Session, host: str = "127.0.0.1", port: int = 8620, sources: Sequence[str] = (), most_bytes: int = 16 << 20) -> ThreadingHTTPServer:
    """A server that is ready to ``serve_forever``."""
    service = Service(session, sources)

    class Handler(BaseHTTPRequestHandler):
        protocol_version = "HTTP/1.1"

        def _run(self) -> None:
            size = int(self.headers.get("Content-Length") or 0)
            if size > most_bytes:
                self.close_connection = True
                self.send_error(413)
                return
            status, kind, out = service.answer(self.command, self.path, self.rfile.read(size))
            self.send_response(status)
            self.send_header("Content-Type", kind)
            if isinstance(out, bytes):
                self.send_header("Content-Length", str(len(out)))
                self.end_headers()
                self.wfile.write(out)
                return
            self.send_header("Transfer-Encoding", "chunked")
            self.end_headers()
            try:  # each batch leaves as soon as Spark has it; a client that goes away ends the query
                with pa.ipc.new_stream(pa.PythonFile(_Chunks(self.wfile), mode="w"), out.schema) as w:
                    for b in out:
                        w.write_batch(b)
                self.wfile.write(b"0\r\n\r\n")
            except Exception:  # noqa: BLE001  the status is sent: a stream without its end tells the client
                self.close_connection = True
            finally:
                out.close()

        do_GET = do_POST = _run

        def log_message(self, *_: Any) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)


class _Chunks:
    """A file object that frames each write as an HTTP chunk."""

    closed = False

    def __init__(self, out: Any):
        self.out = out

    def write(self, data: Any) -> int:
        b = bytes(data)
        if b:
            self.out.write(f"{len(b):x}\r\n".encode() + b + b"\r\n")
        return len(b)

    def flush(self) -> None:
        self.out.flush()

    def writable(self) -> bool:
        return True

    def close(self) -> None:
        pass
