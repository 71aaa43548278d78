"""The session over HTTP gives what the session gives."""

import json
import threading
import urllib.request
from functools import partial
from http.server import SimpleHTTPRequestHandler, ThreadingHTTPServer

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from ridgeline.__main__ import main
from ridgeline.vector import IVF, connect
from ridgeline.vector.client import Client
from ridgeline.vector.errors import AlreadyExists, Corrupt, InvalidArgument, NotFound
from ridgeline.vector.maintenance import publish
from ridgeline.vector.server import serve
from ridgeline.vector.storage import Warehouse


def test_parity(spark, tmp_path, capsys):
    path = tmp_path / "d.parquet"
    pq.write_table(pa.table({"id": [1, 2, 3], "embedding": pa.array([[0.0, 0.0], [1.0, 0.0], [10.0, 0.0]], pa.list_(pa.float32()))}), path)
    with connect(spark, str(tmp_path / "w")) as session:
        server = serve(session, port=0, sources=[f"{tmp_path}/*.parquet"])
        threading.Thread(target=server.serve_forever, daemon=True).start()
        c = Client(f"http://127.0.0.1:{server.server_port}")
        c.register_parquet("docs", str(path))
        for bad in ("/etc/x.parquet", f"{tmp_path}/../x.parquet"):
            with pytest.raises(InvalidArgument):
                c.register_parquet("other", bad)
        assert c.list_tables() == ["docs"] and [x["name"] for x in c.describe("docs")["columns"]] == ["id", "embedding"]
        assert c.create_index("docs", "i", "embedding", ["id"], IVF(2))["phase"] == "ready"
        with pytest.raises(AlreadyExists):
            c.create_index("docs", "i", "embedding", ["id"], IVF(2))
        q = c.search("docs", [0, 0]).limit(2).nprobes(2).where("id > 1").select(["id"])
        assert c.collect(q).to_pylist() == session.collect(q).to_pylist() == [{"id": 2, "_distance": 1.0}, {"id": 3, "_distance": 100.0}]
        assert sum(b.num_rows for b in c.stream("SELECT * FROM range(20000)")) == 20000
        assert c.sql(c.to_sql(q)).num_rows == 2 and "TakeOrdered" in c.explain(q) and c.explain("SELECT 1")
        assert c.list_indexes("docs")[0]["rows"] == 3 and c.refresh_index("docs", "i")["published"]
        for bad in ("WITH c AS (SELECT 1 AS a) INSERT INTO docs SELECT a, NULL FROM c", "FROM docs INSERT INTO a SELECT id INSERT INTO b SELECT id", f"SELECT * FROM parquet.`{path}`", "SELECT reflect('java.lang.Math', 'abs', 1)"):
            with pytest.raises(InvalidArgument):
                c.sql(bad)
        for call, error in ((lambda: c.sql("DROP TABLE docs"), InvalidArgument), (lambda: c.index_status("docs", "none"), NotFound), (lambda: c.describe("none"), NotFound), (lambda: c._json("/v1/table/docs/query", {"vector": [0], "what": 1}), InvalidArgument), (lambda: c._json("/nothing"), NotFound)):
            with pytest.raises(error):
                call()
        with urllib.request.urlopen(c.url + "/openapi.json") as f:
            assert "/v1/table/{table}/query" in json.load(f)["paths"]
        assert main(["publish", str(tmp_path / "w"), "docs", "i", str(tmp_path / "p")]) == 0 and "metadata" in capsys.readouterr().out
        assert main(["config", str(tmp_path / "c.json")]) == 0
        c.drop_index("docs", "i")
        c.deregister_table("docs")
        assert c.list_tables() == []
        server.shutdown()


def test_publication_is_read_again(spark, tmp_path):
    path = tmp_path / "d.parquet"
    pq.write_table(pa.table({"id": [1, 2, 3], "embedding": pa.array([[0.0, 0.0], [1.0, 0.0], [10.0, 0.0]], pa.list_(pa.float32()))}), path)
    with connect(spark, str(tmp_path / "w")) as session:
        session.register_parquet("docs", str(path)).create_index("i", "embedding", "id", IVF(2, "lvq8"))
        location = session.catalog.load("docs", "i")
        (tmp_path / "p").mkdir()
        (tmp_path / "q").mkdir()
        server = ThreadingHTTPServer(("127.0.0.1", 0), partial(Quiet, directory=str(tmp_path / "p")))
        threading.Thread(target=server.serve_forever, daemon=True).start()
        url = f"http://127.0.0.1:{server.server_port}"
        done = publish(session.warehouse, location, Warehouse(str(tmp_path / "p")), url)
        assert done[-1] == location
        with pytest.raises(Corrupt, match="differs|cannot be read"):  # another place is served
            (tmp_path / "p" / location).write_text("{}")
            publish(session.warehouse, location, Warehouse(str(tmp_path / "q")), url)
        server.shutdown()


class Quiet(SimpleHTTPRequestHandler):
    def log_message(self, *_):
        pass
