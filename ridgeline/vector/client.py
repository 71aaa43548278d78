"""A client of the HTTP server with the names of the session."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import asdict
from typing import Any
from urllib.error import HTTPError
from urllib.parse import quote
from urllib.request import Request, urlopen

import pyarrow as pa

from ridgeline.vector import errors
from ridgeline.vector.config import IVF
from ridgeline.vector.query import VectorQuery
from ridgeline.vector.server import query_to_json


class Client:
    def __init__(self, url: str, timeout: float = 600):
        self.url, self.timeout = url.rstrip("/"), timeout

    def _open(self, path: str, doc: dict | None = None) -> Any:
        r = Request(self.url + path, None if doc is None else json.dumps(doc).encode(), {"Content-Type": "application/json"})
        try:
            return urlopen(r, timeout=self.timeout)  # noqa: S310
        except HTTPError as e:
            said = json.loads(e.read() or b"{}")
            raise getattr(errors, said.get("error", ""), errors.Backend)(said.get("message", str(e))) from None

    def _json(self, path: str, doc: dict | None = None) -> dict:
        with self._open(path, doc) as f:
            return json.load(f)

    def list_tables(self) -> list[str]:
        return self._json("/v1/table")["tables"]

    def register_parquet(self, name: str, path: str) -> None:
        self._json(f"/v1/table/{quote(name)}/register", {"path": path})

    def describe(self, name: str) -> dict:
        return self._json(f"/v1/table/{quote(name)}/describe")

    def deregister_table(self, name: str) -> None:
        self._json(f"/v1/table/{quote(name)}/deregister", {})

    def create_index(self, table: str, name: str, column: str, keys: Sequence[str], config: IVF, wait: bool = True) -> dict:
        return self._json(f"/v1/table/{quote(table)}/create_index", {"name": name, "column": column, "keys": list(keys), "config": asdict(config), "wait": wait})

    def index_status(self, table: str, name: str) -> dict:
        return self._json(f"/v1/table/{quote(table)}/index/{quote(name)}/stats")

    def list_indexes(self, table: str) -> list[dict]:
        return self._json(f"/v1/table/{quote(table)}/index/list")["indexes"]

    def refresh_index(self, table: str, name: str, wait: bool = True) -> dict:
        return self._json(f"/v1/table/{quote(table)}/index/{quote(name)}/refresh", {"wait": wait})

    def drop_index(self, table: str, name: str) -> None:
        self._json(f"/v1/table/{quote(table)}/index/{quote(name)}/drop", {})

    def search(self, table: str, vector: Sequence[float], **named: Any) -> VectorQuery:
        return VectorQuery(table, tuple(map(float, vector)), **named)

    def stream(self, query: VectorQuery | str) -> Iterator[pa.RecordBatch]:
        path, doc = ("/v1/sql", {"sql": query}) if isinstance(query, str) else (f"/v1/table/{quote(query.source)}/query", query_to_json(query))
        with self._open(path, doc) as f, pa.ipc.open_stream(f) as r:
            yield from r

    def collect(self, query: VectorQuery | str) -> pa.Table:
        path, doc = ("/v1/sql", {"sql": query}) if isinstance(query, str) else (f"/v1/table/{quote(query.source)}/query", query_to_json(query))
        with self._open(path, doc) as f, pa.ipc.open_stream(f) as r:
            return r.read_all()

    sql = collect

    def to_sql(self, query: VectorQuery) -> str:
        return self._json(f"/v1/table/{quote(query.source)}/to_sql", query_to_json(query))["sql"]

    def explain(self, query: VectorQuery | str) -> str:
        return self._json("/v1/sql/explain", {"sql": query})["plan"] if isinstance(query, str) else self._json(f"/v1/table/{quote(query.source)}/explain", query_to_json(query))["plan"]
