"""Queries of the vector engine over the embeddings table. Searching all clusters must equal the exact search, which SQL can state."""

from __future__ import annotations

import asyncio
import threading
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ridgeline import functions as E
from ridgeline.plans.lineage import scratch_folder
from ridgeline.plans.registry import Registry
from ridgeline.sources.tables import table
from ridgeline.vector import IVF, SessionConfig, connect, connect_async, search
from ridgeline.vector.client import Client
from ridgeline.vector.maintenance import publish
from ridgeline.vector.server import serve
from ridgeline.vector.storage import Warehouse

query = Registry()
_D = "list_distance(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) ** 2"
_Q = "(SELECT embedding FROM embeddings WHERE vec_id = 0) q"


def _first(spark: SparkSession, d: str) -> list[float]:
    return table(spark, d, "embeddings").where("vec_id = 0").first()["embedding"]


def _indexed(spark: SparkSession, d: str, config: IVF, **how) -> DataFrame:
    session = connect(spark, scratch_folder(spark))
    t = session.register_parquet("vectors", f"{d}/embeddings.parquet")
    t.create_index("i", "embedding", "vec_id", config)
    q = t.search(_first(spark, d)).limit(how.get("k", 20)).nprobes(how.get("nprobe", config.nlist))
    if "where" in how:
        q = q.where(how["where"])
    return session.dataframe(q).select("vec_id", F.round(F.col("_distance").cast("double"), how.get("digits", 4)).alias("dist"))


@query(f"SELECT e.vec_id, round({_D}, 4) AS dist FROM embeddings e, {_Q} ORDER BY {_D}, e.vec_id LIMIT 20")
def exact_topk(spark: SparkSession, d: str) -> DataFrame:
    session = connect(spark, scratch_folder(spark))
    t = session.register_parquet("vectors", f"{d}/embeddings.parquet")
    return session.dataframe(t.search(_first(spark, d)).limit(20).bypass_vector_index()).select("vec_id", F.round(F.col("_distance").cast("double"), 4).alias("dist"))


@query(f"SELECT e.vec_id, round({_D}, 4) AS dist FROM embeddings e, {_Q} WHERE e.label = 3 ORDER BY {_D}, e.vec_id LIMIT 10")
def exact_topk_filtered(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").where("label = 3")
    q = F.array(*[F.lit(float(x)) for x in _first(spark, d)])
    return rows.select("vec_id", E.squared_l2("embedding", q).cast("double").alias("raw")).orderBy("raw", "vec_id").limit(10).select("vec_id", F.round("raw", 4).alias("dist"))


@query(f"SELECT e.vec_id, round({_D}, 4) AS dist FROM embeddings e, {_Q} ORDER BY {_D}, e.vec_id LIMIT 20")
def ivf_source_all_clusters(spark: SparkSession, d: str) -> DataFrame:
    return _indexed(spark, d, IVF(16))


@query(f"SELECT e.vec_id, round({_D}, 4) AS dist FROM embeddings e, {_Q} WHERE e.label IN (1, 2) ORDER BY {_D}, e.vec_id LIMIT 20")
def ivf_source_filtered(spark: SparkSession, d: str) -> DataFrame:
    return _indexed(spark, d, IVF(16), where="label IN (1, 2)")


@query(f"SELECT e.vec_id, round({_D} / 2, 4) AS dist FROM embeddings e, {_Q} ORDER BY {_D}, e.vec_id LIMIT 20")
def ivf_cosine_all_clusters(spark: SparkSession, d: str) -> DataFrame:
    return _indexed(spark, d, IVF(16, metric="cosine"))


@query()
def ivf_source_probed(spark: SparkSession, d: str) -> DataFrame:
    return _indexed(spark, d, IVF(16), nprobe=4)


@query()
def ivf_lvq8_probed(spark: SparkSession, d: str) -> DataFrame:
    return _indexed(spark, d, IVF(16, "lvq8"), nprobe=4)


_DECODED = """SELECT vec_id, round(dist, 3) AS dist FROM (SELECT e.vec_id, list_sum(list_transform(list_zip(e.x, q.x), lambda p: (e.lo::FLOAT::DOUBLE + ((e.hi - e.lo) / {top})::FLOAT::DOUBLE * floor({top} * (p[1] - e.lo) / (e.hi - e.lo) + 0.5) - p[2]) ** 2)) AS dist
FROM (SELECT vec_id, embedding::DOUBLE[] AS x, list_min(embedding)::DOUBLE AS lo, list_max(embedding)::DOUBLE AS hi FROM embeddings {where}) e, (SELECT embedding::DOUBLE[] AS x FROM embeddings WHERE vec_id = 0) q) ORDER BY dist::FLOAT, vec_id LIMIT 20"""


@query(_DECODED.format(top=15, where=""))
def ivf_lvq4_all_clusters(spark: SparkSession, d: str) -> DataFrame:
    return _indexed(spark, d, IVF(16, "lvq4"), digits=3)


@query(_DECODED.format(top=255, where="WHERE label < 5"))
def ivf_lvq8_filtered(spark: SparkSession, d: str) -> DataFrame:
    return _indexed(spark, d, IVF(16, "lvq8"), where="label < 5", digits=3)


@query("SELECT 'clusters' AS what, 16 AS n UNION ALL SELECT 'rows', count(*) FROM embeddings UNION ALL SELECT 'all clusters found', 20 UNION ALL SELECT 'four clusters found some', 1 UNION ALL SELECT 'files', 1 UNION ALL SELECT 'routed', 4 UNION ALL SELECT 'first is itself', 0")
def ivf_recall(spark: SparkSession, d: str) -> DataFrame:
    """What an index holds, and how much of the exact answer it finds."""
    session = connect(spark, scratch_folder(spark))
    t = session.register_parquet("vectors", f"{d}/embeddings.parquet")
    t.create_index("i", "embedding", "vec_id", IVF(16))
    near = t.search(_first(spark, d)).limit(20)
    _, snapshot = session._chosen(near)
    centroids = search._centroids(session.warehouse.uri, search.relations(session.warehouse, snapshot)[0], int(snapshot["parameters"]["dimension"]))
    cids = search.route(centroids, search.canonical_query(near.vector, None, "l2_squared"), 4)
    some = search.postings(spark, session.warehouse, snapshot, cids)
    exact = session.dataframe(near.bypass_vector_index().select(["vec_id"])).withColumn("q", F.lit(0))
    full = search.recall(exact, session.dataframe(near.nprobes(16).select(["vec_id"])).withColumn("q", F.lit(0)), "q", "vec_id").first()["recall"]
    part = session.recall(near.nprobes(4), "vec_id")
    rows = [
        ("clusters", len(centroids)), ("rows", search.postings(spark, session.warehouse, snapshot, None).count()), ("all clusters found", round(20 * full)), ("four clusters found some", int(part > 0)), ("files", int(some.count() < snapshot["indexed-rows"])),
        ("routed", some.select("cid").distinct().count()), ("first is itself", session.dataframe(near.nprobes(1)).first()["vec_id"]),
    ]
    return spark.createDataFrame(rows, "what string, n bigint")


@query("""SELECT * FROM (VALUES ('created', 'l2_squared', 'source', 8), ('refreshed', 'l2_squared', 'lvq8', 4), ('attached', 'l2_squared', 'lvq8', 4)) t(step, metric, encoding, nlist), (SELECT count(*) AS n FROM embeddings)""")
def ivf_life_cycle(spark: SparkSession, d: str) -> DataFrame:
    """Created, refreshed with other settings, published to another warehouse and attached there."""
    where, out = scratch_folder(spark), []

    def note(step: str, t) -> None:
        (i,) = t.list_indexes()
        out.append((step, i["metric"], i["encoding"], i["nlist"], i["rows"]))

    with connect(spark, f"{where}/a") as session:
        t = session.register_parquet("vectors", f"{d}/embeddings.parquet")
        t.create_index("i", "embedding", "vec_id", IVF(8))
        note("created", t)
        t.refresh_index("i", IVF(4, "lvq8"))
        note("refreshed", t)
        assert t.index_status("i")["phase"] == "ready" and session.maintenance().remove_orphans() == [] and session.leases.alive("build") == []
        location = session.catalog.load("vectors", "i")
        publish(session.warehouse, location, Warehouse(f"{where}/b"))
        other = connect(spark, f"{where}/b")
        u = other.register_parquet("vectors", f"{d}/embeddings.parquet")
        u.register_index("i", location)
        note("attached", u)
        first = lambda s, x: [(r["vec_id"], r["_distance"]) for r in s.collect(x.search(_first(spark, d)).limit(5).nprobes(2)).to_pylist()]
        assert first(session, t) == first(other, u) and "Scan" in session.explain(t.search(_first(spark, d))) and session.analyze(t.search(_first(spark, d)).limit(5))["rows"] == 5
        other.close()
    return spark.createDataFrame(out, "step string, metric string, encoding string, nlist int, n bigint")


@query(f"SELECT vec_id, round(dist, 4) AS dist FROM (SELECT e.vec_id, {_D} AS dist FROM embeddings e, {_Q} WHERE e.label = 2) ORDER BY dist, vec_id LIMIT 7")
def http_search(spark: SparkSession, d: str) -> DataFrame:
    """The same search through the server and its client; the batches come as Spark has them."""
    with connect(spark, scratch_folder(spark), SessionConfig(query_concurrency=2)) as session:
        server = serve(session, port=0, sources=[f"{d}/*.parquet"])
        threading.Thread(target=server.serve_forever, daemon=True).start()
        client = Client(f"http://127.0.0.1:{server.server_port}")
        client.register_parquet("vectors", f"{d}/embeddings.parquet")
        assert client.list_tables() == ["vectors"] and client.describe("vectors")["columns"][0]["name"] == "vec_id"
        got = client.collect(client.search("vectors", _first(spark, d)).where("label = 2").limit(7).select(["vec_id"]).bypass_vector_index())
        assert client.sql("SELECT count(*) AS n FROM vectors").num_rows == 1
        server.shutdown()
    return spark.createDataFrame(got).select("vec_id", F.round(F.col("_distance").cast("double"), 4).alias("dist"))


@query(f"SELECT query_no, vec_id, round(raw, 4) AS dist FROM (SELECT q.n AS query_no, e.vec_id, {_D} AS raw, row_number() OVER (PARTITION BY q.n ORDER BY {_D}, e.vec_id) AS r FROM embeddings e, (SELECT vec_id AS n, embedding FROM embeddings WHERE vec_id < 3) q) WHERE r <= 4")
def session_batch(spark: SparkSession, d: str) -> DataFrame:
    """Several queries of a session in one plan, through an awaited session."""
    some = {r["vec_id"]: r["embedding"] for r in table(spark, d, "embeddings").where("vec_id < 3").collect()}

    async def run() -> DataFrame:
        session = await connect_async(spark, scratch_folder(spark))
        t = (await session.register_parquet("vectors", f"{d}/embeddings.parquet")).session
        await asyncio.to_thread(t.create_index, "i", "embedding", "vec_id", IVF(4))
        return await session.batch([t.search(some[i]).limit(4).nprobes(4).select(["vec_id"]) for i in sorted(some)])

    return asyncio.run(run()).select(F.col("query_no").cast("bigint").alias("query_no"), "vec_id", F.round(F.col("_distance").cast("double"), 4).alias("dist"))


_LVQ = """SELECT vec_id, {code} AS code, round(lo, 6) AS lo, round((hi - lo) / {top}, 7) AS scale FROM (
SELECT vec_id, embedding::DOUBLE[] AS x, list_min(embedding)::DOUBLE AS lo, list_max(embedding)::DOUBLE AS hi FROM embeddings)"""


@query(_LVQ.format(code="list_transform(x, lambda v: CAST(floor(255 * (v - lo) / (hi - lo) + 0.5) AS INTEGER))", top=255))
def lvq8_codes(spark: SparkSession, d: str) -> DataFrame:
    """Encoding as declarative arithmetic; the index writer does the same in NumPy."""
    x = F.col("embedding").cast("array<double>")
    rows = table(spark, d, "embeddings").select("vec_id", x.alias("x"), F.array_min(x).alias("lo"), F.array_max(x).alias("hi"))
    code = F.transform("x", lambda v: F.floor(255 * (v - F.col("lo")) / (F.col("hi") - F.col("lo")) + 0.5).cast("int"))
    return rows.select("vec_id", code.alias("code"), F.round("lo", 6).alias("lo"), F.round((F.col("hi") - F.col("lo")) / 255, 7).alias("scale"))


@query("SELECT vec_id, round(list_inner_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 5) AS ip, round(list_cosine_distance(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 5) AS cd, round(list_distance(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 5) AS l2 FROM embeddings e, " + _Q)
def vector_functions(spark: SparkSession, d: str) -> DataFrame:
    q = F.array(*[F.lit(float(x)) for x in _first(spark, d)])
    return table(spark, d, "embeddings").select("vec_id", F.round(E.inner_product("embedding", q), 5).alias("ip"), F.round(E.cosine_distance("embedding", q), 5).alias("cd"), F.round(E.array_distance("embedding", q), 5).alias("l2"))


BLOCK = 100_000  # queries of one pass


def _matrix(column) -> np.ndarray:
    """Rows of equal length, without a Python value an element."""
    ends = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]].astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


@query(f"""WITH p AS (SELECT q.vec_id AS qid, e.vec_id, {_D} AS raw FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 20 = 0) q)
SELECT qid, vec_id, round(raw, 4) AS dist FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY raw, vec_id) AS r FROM p) WHERE r <= 5""")
def batch_topk(spark: SparkSession, d: str) -> DataFrame:
    """A stated query set against all rows: blocks of queries meet the table in one scan each, as a matrix product, and only k rows a query and partition go on."""
    e = table(spark, d, "embeddings")
    asked = e.where("vec_id % 20 = 0").select("vec_id", "embedding")  # the stated query set
    blocks = max(1, -(-asked.count() // BLOCK))
    # A block of queries is small whatever their number: one pass over the table for each.
    return reduce(DataFrame.unionAll, [_block(e, asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b)) for b in range(blocks)])


def _block(e: DataFrame, queries: DataFrame) -> DataFrame:
    import pyarrow as pa

    asked = queries.toArrow().combine_chunks()
    ids = asked["vec_id"].to_numpy()
    shared = e.sparkSession.sparkContext.broadcast((ids, _matrix(asked["embedding"].combine_chunks())))

    def scan(batches):
        qids, q = shared.value
        for b in batches:
            x = _matrix(b.column(1))
            v = b.column(0).to_numpy()
            d2 = ((q**2).sum(1)[:, None] + (x**2).sum(1)[None] - 2 * q @ x.T) if len(x) else np.zeros((len(q), 0))
            if len(x) > 5:  # up to the 5th smallest, with a margin for rounding: ties are settled by the exact order
                norm = (q**2).sum(1)[:, None] + (x**2).sum(1)[None]
                wrong = norm * (4 * (x.shape[1] + 8) * 2.0**-53)
                kth = np.partition(d2 + wrong, 4, axis=1)[:, 4]
                i, j = np.nonzero(~(d2 - wrong > kth[:, None]))
            else:
                i, j = np.repeat(np.arange(len(q)), len(x)), np.tile(np.arange(len(x)), len(q))
            exact = np.concatenate([((q[i[c : c + 65536]] - x[j[c : c + 65536]]) ** 2).sum(1) for c in range(0, len(i), 65536)] or [np.zeros(0)])
            o = np.lexsort((v[j], exact, i))
            i, j, exact = i[o], j[o], exact[o]
            best = np.arange(len(i)) - np.searchsorted(i, i) < 5
            i, j, exact = i[best], j[best], exact[best]
            yield pa.RecordBatch.from_arrays([pa.array(qids[i]), pa.array(v[j]), pa.array(exact)], names=["qid", "vec_id", "raw"])

    found = e.select("vec_id", "embedding").mapInArrow(scan, "qid bigint, vec_id bigint, raw double")
    w = Window.partitionBy("qid").orderBy("raw", "vec_id")
    return found.withColumn("r", F.row_number().over(w)).where("r <= 5").select("qid", "vec_id", F.round("raw", 4).alias("dist"))


@query(f"""SELECT label, count(*) AS n, round(avg(dist), 4) AS mean FROM (SELECT e.vec_id, e.label, {_D} AS dist FROM embeddings e, {_Q} ORDER BY dist, e.vec_id LIMIT 50) GROUP BY label""")
def hits_composed_with_sql(spark: SparkSession, d: str) -> DataFrame:
    session = connect(spark, scratch_folder(spark))
    t = session.register_parquet("vectors", f"{d}/embeddings.parquet")
    t.df.createOrReplaceTempView("embeddings")
    sql = session.to_sql(t.search(_first(spark, d)).limit(50).bypass_vector_index().select(["vec_id"]))
    return session.dataframe(f"SELECT e.label, count(*) AS n, round(avg(CAST(h._distance AS DOUBLE)), 4) AS mean FROM ({sql}) h JOIN embeddings e ON h.vec_id = e.vec_id GROUP BY e.label")


QUERIES, ORACLE = query.queries, query.sql
