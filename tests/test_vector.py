"""Golden cases of the formats and queries, and the life cycle of an index, through the public interface."""

import asyncio
import os
import pickle
from datetime import date, timedelta

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ridgeline.vector import IVF, SessionConfig, VectorQuery, WriteOptions, connect, connect_async, lvq
from ridgeline.vector.catalog import Catalog
from ridgeline.vector.errors import AlreadyExists, Backend, Busy, Conflict, Corrupt, EngineError, InvalidArgument, InvalidSchema, NotFound
from ridgeline.vector.formats import check_metadata, check_postings, current, fingerprint, load, successor
from ridgeline.vector.maintenance import publish
from ridgeline.vector.search import route
from ridgeline.vector.session import AsyncSession
from ridgeline.vector.storage import Warehouse
from ridgeline.vector.training import budgets, closest, recovered_roots, train

F1 = [("a", "Alpha", 1, "published", [0.0, 0.0]), ("b", "Beta", 1, "draft", [1.0, 0.0]), ("c", "Gamma", 2, "published", [10.0, 0.0])]


def save(path, columns, rows, vector="embedding", kind=pa.float32()):
    cols = {c: [r[i] for r in rows] for i, c in enumerate(columns)}
    cols[vector] = pa.array(cols[vector], pa.list_(kind))
    pq.write_table(pa.table(cols), path)
    return str(path)


@pytest.fixture
def session(spark, tmp_path):
    with connect(spark, str(tmp_path / "w")) as s:
        yield s


@pytest.fixture
def documents(session, tmp_path):
    return session.register_parquet("documents", save(tmp_path / "d.parquet", ["document_id", "title", "tenant_id", "status", "embedding"], F1))


def rows(session, query, key="document_id"):
    return [(r[key], r["_distance"]) for r in session.collect(query).to_pylist()]


@pytest.mark.parametrize("encoding", ["source", "lvq8", "lvq4"])
def test_index_equals_exact_when_all_clusters_are_probed(session, documents, encoding):
    documents.create_index("i", "embedding", "document_id", IVF(2, encoding))
    q = documents.search([0, 0]).limit(3).nprobes(2)
    near = lambda pairs: [(k, pytest.approx(d, rel=1e-6, abs=1e-9)) for k, d in pairs]  # noqa: E731, quantised distances differ in the last bit
    assert rows(session, q) == near([("a", 0), ("b", 1), ("c", 100)])
    assert rows(session, documents.search([0, 0]).limit(3).bypass_vector_index()) == [("a", 0), ("b", 1), ("c", 100)]
    assert rows(session, q.where("status = 'published'")) == near([("a", 0), ("c", 100)])
    assert rows(session, q.where("status = 'missing'")) == []
    assert session.collect(q.select(["title"])).column_names == ["title", "_distance"]
    assert rows(session, documents.search([10, 0]).nprobes(1).limit(10)) == near([("c", 0)])


def test_lvq_golden_values():
    x = np.array([[0, 0.5, 1], [2, 2, 2], [10, 11, 12]], np.float32)
    for bits, code, d in ((8, "0080ff", 1.2519646289888504), (4, "800f", 1.2844444444444445)):
        o, s, c = lvq.encode(x, bits)
        assert c[0].tobytes().hex() == code
        got = (lvq.decode(o, s, c, 3, bits) ** 2).sum(1)
        assert got[0] == pytest.approx(d, rel=1e-6) and got[1] == 12


@settings(max_examples=60, deadline=None)
@given(st.lists(st.floats(-1e6, 1e6, width=32), min_size=1, max_size=9), st.sampled_from([4, 8]))
def test_lvq_error_is_half_a_step(values, bits):
    x = np.array([values], np.float32)
    o, s, c = lvq.encode(x, bits)
    step = (x.max() - x.min()) / ((1 << bits) - 1)
    assert (abs(lvq.decode(o, s, c, x.shape[1], bits) - x) <= step / 2 + abs(x).max() * 1e-6 + 1e-30).all()


def test_routing_ties_go_to_the_smaller_cluster():
    assert route(np.array([[0.5, 0], [10, 0]]), np.array([5.25, 0]), 1).tolist() == [0]
    assert closest(np.array([[5.0, 0]], np.float32), np.array([[0, 0], [10, 0]], np.float32))[0].tolist() == [0]


def test_training_keeps_its_promises():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 8)).astype(np.float32)
    h = train(x, 37, 10, 42)
    again = train(x, 37, 10, 42)
    assert len(h.leaves) == 37 and h.offsets[0] == 0 and h.offsets[-1] == 37 and (np.diff(h.offsets) > 0).all() and len(h.roots) == len(h.offsets) - 1
    assert np.array_equal(h.leaves, again.leaves)
    same = train(np.ones((50, 4), np.float32), 20, 5, 1)
    assert len(same.leaves) == 20
    assert budgets(np.array([1, 1, 98]), 50).tolist() == [1, 1, 48]


@pytest.mark.parametrize("encoding", ["source", "lvq8", "lvq4"])
def test_cosine(session, tmp_path, encoding):
    t = session.register_parquet("c", save(tmp_path / "c.parquet", ["document_id", "embedding"], [("x", [2.0, 0.0]), ("diagonal", [1.0, 1.0]), ("y", [0.0, 3.0])], kind=pa.float64()))
    t.create_index("i", "embedding", "document_id", IVF(2, encoding, "cosine"))
    got = rows(session, t.search([10, 0]).nprobes(2))
    assert [k for k, _ in got] == ["x", "diagonal", "y"] and [d for _, d in got] == pytest.approx([0, 1 - 2**-0.5, 1], abs=1e-5)
    assert [d for _, d in rows(session, t.search([2, 0]).bypass_vector_index())] == pytest.approx([0, 2, 13])


def test_composite_key(session, tmp_path):
    t = session.register_parquet("k", save(tmp_path / "k.parquet", ["tenant_id", "document_id", "embedding"], [(1, "b", [0.0, 0.0]), (1, "a", [0.0, 0.0]), (2, "a", [10.0, 0.0])]))
    t.create_index("i", "embedding", ["tenant_id", "document_id"], IVF(2))
    got = session.collect(t.search([0, 0]).nprobes(2).limit(3)).to_pylist()
    assert [(r["tenant_id"], r["document_id"], r["_distance"]) for r in got] == [(1, "a", 0), (1, "b", 0), (2, "a", 100)]


def test_all_key_types_and_duplicate_keys(session, tmp_path):
    keys = {"flag": [True, False], "small": pa.array([1, 2], pa.int32()), "large": [3, 4], "blob": [b"x", b"y"], "name": ["n", "m"], "day": [date(2024, 1, 1), date(2024, 1, 2)]}
    pq.write_table(pa.table(keys | {"embedding": pa.array([[0.5, 0], [-0.5, 0]], pa.list_(pa.float32()))}), tmp_path / "t.parquet")
    t = session.register_parquet("t", str(tmp_path / "t.parquet"))
    t.create_index("i", "embedding", list(keys), IVF(1))
    assert [r["_distance"] for r in session.collect(t.search([0, 0])).to_pylist()] == [0.25, 0.25]
    d = session.register_parquet("dup", save(tmp_path / "dup.parquet", ["document_id", "embedding"], [("same", [0.0]), ("same", [1.0])]))
    d.create_index("i", "embedding", "document_id", IVF(1))
    assert d.list_indexes()[0]["rows"] == 2


@pytest.mark.parametrize(
    ("columns", "vectors", "key", "config", "error", "part"),
    [
        (["document_id"], None, "document_id", IVF(1), InvalidSchema, "vector column not found"),
        (["document_id"], "scalar", "document_id", IVF(1), InvalidSchema, "list<float>"),
        (["document_id"], [[1.0], None], "document_id", IVF(1), InvalidSchema, "must not contain nulls"),
        (["document_id"], [[1.0], [None]], "document_id", IVF(1), InvalidSchema, "finite, non-null"),
        (["document_id"], [[1.0], [1.0, 2.0]], "document_id", IVF(1), InvalidSchema, "same positive dimension"),
        (["document_id"], [[1.0], [float("nan")]], "document_id", IVF(1), InvalidSchema, "finite"),
        (["null_key"], [[1.0], [2.0]], "null_key", IVF(1), Backend, "must not contain nulls"),
        (["score"], [[1.0], [2.0]], "score", IVF(1), InvalidSchema, "unsupported source key type"),
        (["document_id"], [[1.0], [2.0]], "other", IVF(1), InvalidSchema, "key column not found"),
        (["document_id"], [[1.0], [2.0]], "document_id", IVF(3), InvalidArgument, "must not exceed ntotal"),
        (["document_id"], [], "document_id", IVF(1), InvalidSchema, "at least one"),
        (["document_id"], [[0.0], [2.0]], "document_id", IVF(1, metric="cosine"), InvalidSchema, "norm"),
    ],
)
def test_invalid_sources(session, tmp_path, columns, vectors, key, config, error, part):
    n = 2 if vectors is None or vectors == "scalar" else len(vectors)
    values = {"document_id": ["a", "b"][:n], "null_key": ["a", None][:n], "score": [0.5, 1.5][:n]}
    cols = {c: values[c] for c in columns}
    if vectors is not None:
        cols["embedding"] = [1.0, 2.0] if vectors == "scalar" else pa.array(vectors, pa.list_(pa.float32()))
    pq.write_table(pa.table(cols), tmp_path / "bad.parquet")
    t = session.register_parquet("bad", str(tmp_path / "bad.parquet"))
    with pytest.raises(error, match=part):
        t.create_index("i", "embedding", key, config)
    status = t.index_status("i")
    assert status["phase"] == "failed" and not status["published"] and t.list_indexes() == []


def test_reserved_column(session, tmp_path):
    with pytest.raises(InvalidSchema, match="reserved"):
        session.register_parquet("r", save(tmp_path / "r.parquet", ["_distance", "embedding"], [(1, [1.0])]))


def test_row_groups_hold_one_cluster_and_files_are_pruned(session, tmp_path):
    rng = np.random.default_rng(5)
    x = (rng.integers(0, 6, 4000)[:, None] * 30 + rng.normal(size=(4000, 6))).astype(np.float32)
    t = session.register_parquet("many", save(tmp_path / "m.parquet", ["id", "embedding"], list(zip(range(4000), x.tolist()))))
    t.create_index("i", "embedding", "id", IVF(40, "lvq8"), WriteOptions(file_bytes=8000, partitions=5))
    snap = current(session.metadata("many", "i"))
    from ridgeline.vector.search import _manifest, relations

    where = relations(session.warehouse, snap)[1]
    m = _manifest(session.warehouse.uri, where)
    assert sum(f["rows"] for f in m["files"]) == 4000 and len(m["files"]) > 8
    for f in m["files"]:
        meta = pq.ParquetFile(pa.BufferReader(session.warehouse.read_bytes(where + f["path"]))).metadata
        for g in range(meta.num_row_groups):
            s = meta.row_group(g).column(0).statistics
            assert s.min == s.max and s.null_count == 0
    q = t.search(x[7].tolist()).limit(10)
    want = {r["id"] for r in session.collect(q.bypass_vector_index()).to_pylist()}
    got = {r["id"] for r in session.collect(q.nprobes(20)).to_pylist()}
    assert len(want & got) >= 8
    session.config = SessionConfig(inline_clusters=4)
    assert {r["id"] for r in session.collect(q.nprobes(20)).to_pylist()} == got


def test_leaves_are_trained_by_tasks(session, tmp_path, monkeypatch):
    from ridgeline.vector import build

    rng = np.random.default_rng(6)
    x = (rng.normal(size=(30, 8))[rng.integers(0, 30, 3000)] * 20 + rng.normal(size=(3000, 8))).astype(np.float32)
    t = session.register_parquet("many", save(tmp_path / "m.parquet", ["id", "embedding"], list(zip(range(3000), x.tolist()))))
    monkeypatch.setattr(build, "LOCAL", 0)
    h = build.train_index(t.df, "embedding", ["id"], 8, 3000, IVF(40, training_rows=50))
    assert len(h.leaves) == 40 and h.offsets[-1] == 40 and (np.diff(h.offsets) > 0).all() and len(h.roots) == len(h.offsets) - 1
    t.create_index("i", "embedding", "id", IVF(40))
    q = t.search(x[5].tolist()).limit(10)
    assert [r["id"] for r in session.collect(q.nprobes(40)).to_pylist()] == [r["id"] for r in session.collect(q.bypass_vector_index()).to_pylist()]


def test_refresh_conflict_and_drop(session, documents, tmp_path):
    documents.create_index("i", "embedding", "document_id", IVF(2))
    base = session.catalog.load("documents", "i")
    with pytest.raises(AlreadyExists):
        documents.create_index("i", "embedding", "document_id", IVF(2))
    with pytest.raises(InvalidArgument):
        documents.refresh_index("i", IVF(2, metric="cosine"))
    documents.refresh_index("i", IVF(1, "lvq8"))
    doc = session.metadata("documents", "i")
    assert doc["last-sequence-number"] == 2 and len(doc["snapshots"]) == 2 and documents.list_indexes()[0]["encoding"] == "lvq8"
    with pytest.raises(Conflict):
        session.catalog.commit("documents", "i", base, "metadata/x.json")
    assert base in session.catalog.tombstones()
    location = session.catalog.load("documents", "i")
    documents.drop_index("i")
    with pytest.raises(NotFound):
        documents.index_status("i")
    documents.register_index("again", location)
    assert rows(session, documents.search([0, 0]).limit(1)) == [("a", 0)]


def test_selection_of_indexes(session, documents):
    with pytest.raises(InvalidArgument, match="no index"):
        session.collect(documents.search([0, 0]))
    documents.create_index("one", "embedding", "document_id", IVF(1))
    documents.create_index("two", "embedding", "document_id", IVF(2))
    with pytest.raises(InvalidArgument, match="several"):
        session.collect(documents.search([0, 0]))
    assert rows(session, documents.search([0, 0], index="one").limit(1)) == [("a", 0)]
    # Both builds share the centroids only where their descriptors are equal.
    assert len(session.catalog.centroid_locations()) == 2
    for bad in (documents.search([0, 0], index="none"), documents.search([0, 0], index="one", column="title"), documents.search([0, 0], index="one").nprobes(2), documents.search([0], index="one"), documents.search([0, float("nan")], index="one"), documents.search([0, 0], index="one").where("nonsense ="), documents.search([0, 0], index="one").select(["nope"]), documents.search([0, 0], index="one").bypass_vector_index()):
        with pytest.raises(EngineError):
            session.collect(bad)
    for bad in ({"limit": 0}, {"nprobes": 0}, {"select": []}, {"where": " "}):
        (name, arg), = bad.items()
        with pytest.raises(InvalidArgument):
            getattr(VectorQuery("t", (1.0,)), name)(arg)


def test_sql_composition_and_gate(session, documents):
    sql = session.to_sql(documents.search([0, 0]).limit(2).bypass_vector_index())
    assert sql == session.to_sql(documents.search([0, 0]).limit(2).bypass_vector_index())
    got = session.sql(f"SELECT d.status, count(*) AS n FROM ({sql}) h JOIN documents d ON h.document_id = d.document_id GROUP BY d.status").to_pylist()
    assert sorted((r["status"], r["n"]) for r in got) == [("draft", 1), ("published", 1)]
    for bad in (
        "DROP TABLE documents", "CREATE TABLE x AS SELECT 1", "INSERT INTO documents SELECT 1", "SET a=b", "", "SELEC 1", "WITH c AS (SELECT 1 AS a) INSERT INTO t SELECT a FROM c",
        "FROM (SELECT 1 AS a) INSERT INTO t SELECT a INSERT INTO u SELECT a", "EXPLAIN INSERT INTO t SELECT 1", "SELECT * FROM parquet.`/tmp/x`", "SELECT (SELECT max(a) FROM csv.`/etc/passwd`)", "SELECT java_method('java.lang.Math', 'abs', 1)",
        "SELECT * FROM documents WHERE reflect('java.lang.Math', 'abs', 1) > 0", "BEGIN SELECT 1; END", "EXECUTE IMMEDIATE 'SELECT 1'", "SELECT TRANSFORM(status) USING 'cat' AS (b) FROM documents", "CACHE TABLE documents", "SELECT * FROM IDENTIFIER('documents')",
    ):
        with pytest.raises(InvalidArgument):
            session.sql(bad)
    for good in ("EXPLAIN SELECT 1", "SHOW TABLES", "DESCRIBE documents", "WITH c AS (SELECT status FROM documents) SELECT status, count(*) FROM c GROUP BY ROLLUP (status) HAVING count(*) > 0 ORDER BY 1 LIMIT 2 OFFSET 1", "SELECT sum(tenant_id) OVER w FROM documents WINDOW w AS (PARTITION BY status)",
                 "SELECT * FROM VALUES (1) AS t(a) UNION SELECT 2 INTERSECT SELECT 3", "SELECT * FROM documents, LATERAL (SELECT tenant_id + 1)", "SELECT * FROM (SELECT status FROM documents) PIVOT (count(*) FOR status IN ('draft'))", "SELECT x.a FROM (SELECT 1 AS a) x LATERAL VIEW explode(array(1)) AS y"):
        session.sql(good)
    for bad in ("reflect('java.lang.Math', 'abs', 1) > 0", "tenant_id IN (SELECT 1)"):
        with pytest.raises(InvalidArgument):
            session.collect(documents.search([0, 0]).bypass_vector_index().where(bad))
    assert "TakeOrderedAndProject" in session.explain(documents.search([0, 0]).bypass_vector_index())
    assert session.analyze("SELECT 1")["rows"] == 1
    assert [b.num_rows for b in session.stream(documents.search([0, 0]).bypass_vector_index())] == [3]


def test_query_is_a_value():
    q = VectorQuery("t", (1.0, 2.0), index="i")
    r = q.limit(3).where("a > 1").select(["a"]).nprobes(2)
    assert q.part("limit") == 10 and q.part("where") is None and r.part("nprobes") == 2 and r.part("select") == ("a",) and not r.part("exact")
    assert r == VectorQuery("t", (1.0, 2.0), index="i").nprobes(2).select(["a"]).limit(3).where("a > 1") != q and hash(r) == hash(pickle.loads(pickle.dumps(r))) and repr(r) == repr(pickle.loads(pickle.dumps(r)))
    with pytest.raises(AttributeError):
        q.index = "x"


def test_streams_batches_and_recall(session, documents):
    documents.create_index("i", "embedding", "document_id", IVF(2))
    q = documents.search([0, 0]).limit(2)
    assert session.recall(q.nprobes(2), "document_id") == 1.0 and 0 <= session.recall(q.nprobes(1), "document_id") <= 1
    both = session.batch([q.nprobes(2), documents.search([10, 0]).nprobes(2).limit(1)]).collect()
    assert sorted((r["query_no"], r["document_id"]) for r in both) == [(0, "a"), (0, "b"), (1, "c")]
    out = session.results("SELECT id AS x, CAST(id AS string) AS s FROM range(30000)")
    assert out.schema.names == ["x", "s"] and sum(b.num_rows for b in out) == 30000
    stats = session.cache_stats()
    assert stats["manifests"]["bytes"] <= stats["manifests"]["most_bytes"] and stats["manifests"]["hits"] + stats["manifests"]["misses"] > 0

    async def read():
        n = 0
        async with AsyncSession(session).stream("SELECT * FROM range(20000)") as s:
            async for b in s:
                n += b.num_rows
        return n

    assert asyncio.run(read()) == 20000
    assert documents.session.maintenance().reachable()


def test_session_settings(spark, tmp_path):
    save(tmp_path / "d.parquet", ["id", "embedding"], [(i, [float(i), 0.0]) for i in range(40)])
    with connect(spark, str(tmp_path / "w"), SessionConfig(build_dop=3, centroid_cache_bytes=0)) as s:
        t = s.register_parquet("d", str(tmp_path / "d.parquet"))
        t.create_index("i", "embedding", "id", IVF(4))
        assert s.collect(t.search([0.0, 0.0]).limit(2).nprobes(1)).num_rows == 2 and s.cache_stats()["centroids"]["entries"] == 0
    with pytest.raises(InvalidArgument):
        SessionConfig(build_dop=-1)
    with connect(spark, str(tmp_path / "w")) as s:
        assert s.cache_stats()["centroids"]["most_bytes"] == 256 << 20


def test_leases(session, documents, spark, tmp_path):
    documents.create_index("i", "embedding", "document_id", IVF(1))
    assert session.leases.alive("session") == [session.owner] and session.leases.alive("build") == []
    stray = session.root / "indexes/stray/1/x"
    stray.parent.mkdir(parents=True)
    stray.write_bytes(b"x")
    os.utime(stray, (1, 1))
    with connect(spark, str(session.root)) as other:
        with pytest.raises(Busy, match="another session"):
            session.maintenance().remove_orphans(dry_run=False)
        assert other.owner in session.leases.alive("session")
    with session.leases.build("stray"):
        assert session.maintenance().remove_orphans() == []
    (session.root / "locks" / "dead.session").touch()  # of a process that died
    assert session.maintenance().remove_orphans(dry_run=False) == ["indexes/stray/1/x"] and not (session.root / "locks" / "dead.session").exists()


def test_build_waits_for_the_centroids_of_another(session, documents, monkeypatch):
    mark = fingerprint("embedding", 2, "l2_squared", 2)
    assert session.catalog.claim_centroids("documents", mark, "other", lease=0.8) is None
    documents.create_index("i", "embedding", "document_id", IVF(2))
    assert documents.index_status("i")["fraction"] == 1.0 and len(session.catalog.centroid_locations()) == 1


def test_roots_without_rows_recover():
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(60, 4)), rng.normal(size=(60, 4)) + 9]).astype(np.float32)
    roots = np.concatenate([x[:1], x[60:61], np.full((1, 4), 1e6, np.float32)])
    label = np.repeat([0, 1], 60)
    new, label = recovered_roots(x, roots, label)
    assert np.bincount(label, minlength=3).all() and abs(new).max() < 100
    with pytest.warns(RuntimeWarning, match="without them"):
        h = train(np.repeat(np.eye(4, dtype=np.float32)[:2], 20, 0), 30, 4, 1)
    assert len(h.leaves) == 30 == h.offsets[-1] and len(h.roots) == len(h.offsets) - 1 and (np.diff(h.offsets) > 0).all()


def test_maintenance_and_publication(session, documents, tmp_path, spark):
    documents.create_index("i", "embedding", "document_id", IVF(2, "lvq8"))
    location = session.catalog.load("documents", "i")
    assert session.maintenance().remove_orphans() == []
    with pytest.raises(InvalidArgument):
        session.maintenance().remove_orphans(timedelta(days=1))
    session.warehouse.create("indexes/stray/1/x.parquet", b"x")
    import os

    old = session.root / "indexes/stray/1/x.parquet"
    os.utime(old, (1, 1))
    assert session.maintenance().remove_orphans() == ["indexes/stray/1/x.parquet"] and old.exists()
    session.maintenance().remove_orphans(dry_run=False)
    assert not old.exists()
    target = Warehouse(str(tmp_path / "p"))
    (tmp_path / "p").mkdir()
    assert publish(session.warehouse, location, target)[-1] == location
    with pytest.raises(AlreadyExists):
        publish(session.warehouse, location, target)
    with connect(spark, str(tmp_path / "p")) as other:
        t = other.register_parquet("documents2", str(tmp_path / "d.parquet"))
        t.register_index("i", location)
        assert rows(other, t.search([10, 0]).limit(1).nprobes(2)) == [("c", pytest.approx(0, abs=1e-9))]


def test_catalog_trace(tmp_path):
    c = Catalog(tmp_path / "c.db")
    with pytest.raises(NotFound):
        c.load("t", "i")
    c.register("t", "i", "base")
    with pytest.raises(AlreadyExists):
        c.register("t", "i", "base")
    c.commit("t", "i", "base", "next")
    with pytest.raises(Conflict):
        c.commit("t", "i", "base", "next")
    assert c.load("t", "i") == "next"
    c.drop("t", "i")
    with pytest.raises(NotFound):
        c.load("t", "i")
    assert c.claim_centroids("t", "f", "me") is None
    with pytest.raises(Conflict):
        c.claim_centroids("t", "f", "you")
    assert c.renew_centroids("t", "f", "me") and not c.renew_centroids("t", "f", "you")
    c.publish_centroids("t", "f", "me", "here")
    assert c.claim_centroids("t", "f", "you") == "here"


def good():
    snap = {"snapshot-id": 7, "summary": {}, "vector-field": "e", "source-key-fields": ["k"], "indexed-rows": 3, "index-family": "ivf", "index-schema-version": 1, "metric": "l2_squared", "parameters": {"artifact_uuid": "x", "dimension": "2", "nlist": "2", "ntotal": "3", "posting_encoding": "lvq8"}, "index-relations": {"artifact_manifest": "indexes/a/1/manifest.json"}}
    return successor(None, snap, "2f1c7f5e-3c43-4a44-8f2a-cf560c4db8d1", 5)


def test_metadata_rules():
    doc = good()
    two = successor(doc, current(doc) | {"snapshot-id": 8}, "", 3)
    assert two["last-sequence-number"] == 2 and two["snapshot-log"][-1]["timestamp-ms"] == 5

    def change(path, value, base=doc):
        import copy

        d = copy.deepcopy(base)
        at = d
        for p in path[:-1]:
            at = at[p]
        at[path[-1]] = value
        return d

    bad = [
        change(("extra",), 1), change(("format-version",), 2), change(("index-uuid",), "ABC"), change(("current-snapshot-id",), 9), change(("snapshots", 0, "source-key-fields"), ["k", "k"]), change(("snapshots", 0, "metric"), "dot"),
        change(("snapshots", 0, "parameters", "nlist"), "02"), change(("snapshots", 0, "parameters", "store_vectors"), "true"), change(("snapshots", 0, "parameters", "posting_encoding"), "flat"), change(("snapshots", 0, "index-relations", "artifact_manifest"), "/abs"),
        change(("snapshots", 0, "index-relations", "artifact_manifest"), "a/../b"), change(("snapshots", 0, "index-relations"), {}), change(("snapshots", 0, "index-relations"), {"other": "x"}), change(("snapshots", 1, "snapshot-id"), 7, two), change(("snapshots", 1, "vector-field"), "f", two),
        change(("snapshot-log", 0, "timestamp-ms"), 99, two), {k: v for k, v in doc.items() if k != "properties"},
    ]
    for d in bad:
        with pytest.raises(Corrupt):
            check_metadata(d)
    with pytest.raises(Corrupt):
        load('{"a": 1, "a": 2}')
    with pytest.raises(Corrupt):
        check_postings({"format-version": 1, "nlist": 2, "ntotal": 1, "cid-offsets": [0, 2], "files": []})
    assert fingerprint("embedding", 2, "l2_squared", 2) == fingerprint("embedding", 2, "l2_squared", 2) != fingerprint("embedding", 2, "cosine", 2)


def test_admission_and_async(spark, tmp_path):
    save(tmp_path / "d.parquet", ["document_id", "title", "tenant_id", "status", "embedding"], F1)
    with connect(spark, str(tmp_path / "w"), SessionConfig(query_queue_capacity=0)) as s:
        t = s.register_parquet("documents", str(tmp_path / "d.parquet"))
        running = s.stream(t.search([0, 0]).bypass_vector_index())
        next(running)
        with pytest.raises(Busy):
            s.collect("SELECT 1")
        running.close()
        assert s.collect("SELECT 1 AS x").to_pylist() == [{"x": 1}]

    async def go():
        s = await connect_async(spark, str(tmp_path / "w"))
        t = await s.table("documents")
        q = await t.search([0, 0])
        return (await s.collect(q.bypass_vector_index())).num_rows

    assert asyncio.run(go()) == 3


def test_batch_topk_keeps_the_smallest_ids_of_ties(spark, tmp_path):
    from ridgeline.plans.vectors import batch_topk

    x = np.random.default_rng(5).integers(1, 9, 8).astype(float).tolist()
    rows = [(i, x, 0) for i in np.random.default_rng(6).permutation(200).tolist()]  # exact copies, in no order
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {}
    for r in batch_topk(spark, str(tmp_path)).collect():
        got.setdefault(r["qid"], []).append(r["vec_id"])
    assert len(got) == 10 and all(sorted(v) == [0, 1, 2, 3, 4] for v in got.values())
