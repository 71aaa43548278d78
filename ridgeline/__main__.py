"""Command line: ``serve`` a warehouse, ``publish`` an index, write an initial ``config``."""

from __future__ import annotations

import argparse
import json
from dataclasses import asdict
from pathlib import Path


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser("ridgeline")
    sub = p.add_subparsers(dest="command", required=True)
    s = sub.add_parser("serve", help="serve a warehouse over HTTP")
    s.add_argument("root")
    s.add_argument("--host", default="127.0.0.1")
    s.add_argument("--port", type=int, default=8620)
    s.add_argument("--source", action="append", default=[], help="pattern of paths that may be registered")
    s.add_argument("--config", help="JSON file as written by config")
    c = sub.add_parser("config", help="write a session configuration with its defaults")
    c.add_argument("path")
    b = sub.add_parser("publish", help="copy an index to an empty warehouse")
    b.add_argument("--verify-url", help="read every object again from below this address")
    b.add_argument("root")
    b.add_argument("table")
    b.add_argument("index")
    b.add_argument("target")
    a = p.parse_args(args)
    from ridgeline.vector.config import SessionConfig

    if a.command == "config":
        with open(a.path, "x") as f:
            json.dump(asdict(SessionConfig()), f, indent=1)
        return 0
    if a.command == "publish":
        from ridgeline.vector.catalog import Catalog
        from ridgeline.vector.maintenance import publish
        from ridgeline.vector.storage import Warehouse

        Path(a.target).mkdir(parents=True, exist_ok=True)
        location = Catalog(Path(a.root) / "catalog.db").load(a.table, a.index)
        print("\n".join(publish(Warehouse(a.root), location, Warehouse(a.target), a.verify_url)))
        return 0
    from pyspark.sql import SparkSession

    from ridgeline.vector.server import serve
    from ridgeline.vector.session import connect

    config = SessionConfig(**json.loads(Path(a.config).read_text())) if a.config else SessionConfig(query_concurrency=8)
    spark = SparkSession.builder.appName("ridgeline").config("spark.scheduler.mode", "FAIR").getOrCreate()
    with connect(spark, a.root, config) as session:
        server = serve(session, a.host, a.port, a.source)
        print(f"http://{a.host}:{server.server_port}", flush=True)
        try:
            server.serve_forever()
        except KeyboardInterrupt:
            pass
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
