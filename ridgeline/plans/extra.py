"""Queries of user-defined functions, formats, the frame interface and streams."""

from __future__ import annotations

import pickle

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.context import SessionContext
from ridgeline.frame import Frame
from ridgeline.functions import custom as udfs
from ridgeline.plans.lineage import scratch_folder
from ridgeline.plans.registry import Registry
from ridgeline.plans.ship import ship
from ridgeline.sources import formats
from ridgeline.sources.tables import table
from ridgeline.streaming.windows import read_stream, run_available, session_totals, window_totals

query = Registry()


class LargestTwo(udfs.Accumulator):
    """The sum of the two largest values."""

    def __init__(self) -> None:
        self.top: list[float] = []

    def update(self, values: pa.Array) -> None:
        self.top = sorted(self.top + values.drop_null().to_pylist())[-2:]

    def state(self) -> bytes:
        return pickle.dumps(self.top)

    def merge(self, states) -> None:
        self.top = sorted(sum((pickle.loads(s) for s in states), self.top))[-2:]

    def evaluate(self) -> float:
        return float(sum(self.top))


@query("SELECT p_partkey, p_size * 2 + 1 AS y FROM part")
def udf_scalar(spark: SparkSession, d: str) -> DataFrame:
    ship(spark)
    f = udfs.udf(lambda x: pc.add(pc.multiply(x, 2), 1), "int")
    return table(spark, d, "part").select("p_partkey", f("p_size").alias("y"))


@query("SELECT o_custkey, round(sum(o_totalprice), 2) AS top FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) AS r FROM orders) WHERE r <= 2 GROUP BY o_custkey")
def udf_aggregate(spark: SparkSession, d: str) -> DataFrame:
    ship(spark)
    got = udfs.udaf(table(spark, d, "orders"), ["o_custkey"], ["o_totalprice"], LargestTwo, "double", "top")
    return got.select("o_custkey", F.round("top", 2).alias("top"))


@query("SELECT event_id, round(value - first_value(value) OVER (PARTITION BY user_id ORDER BY event_id), 6) AS diff FROM events")
def udf_window(spark: SparkSession, d: str) -> DataFrame:
    ship(spark)
    rows = table(spark, d, "events").select("event_id", "user_id", "value")
    got = udfs.udwf(rows, ["user_id"], ["event_id"], lambda t: pc.subtract(t["value"], t["value"][0]), "double", "diff")
    return got.select("event_id", F.round("diff", 6).alias("diff"))


@query("SELECT n_nationkey, i.i AS i FROM nation, LATERAL (SELECT unnest(range(0, n_nationkey % 4)) AS i) i")
def udf_table(spark: SparkSession, d: str) -> DataFrame:
    ship(spark)

    class Upto:
        def eval(self, n: int):
            for i in range(n):
                yield (i,)

    udfs.udtf(spark, "upto", Upto, "i bigint")
    table(spark, d, "nation").createOrReplaceTempView("nation")
    return spark.sql("SELECT n_nationkey, u.i FROM nation, LATERAL upto(n_nationkey % 4) u")


def _round_trip(kind: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        ship(spark)
        rows = table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", F.round("c_acctbal", 2).alias("c_acctbal"), "c_mktsegment")
        where = scratch_folder(spark)
        schema = "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
        if kind == "parquet":
            Frame(rows).write_parquet(where, formats.ParquetWriterOptions(bloom_filters=["c_custkey"]), formats.WriteOptions(partition_by=["c_mktsegment"], sort_by=["c_custkey"]))
            return formats.read_parquet(spark, where).select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
        if kind == "csv":
            Frame(rows).write_csv(where)
            return formats.read_csv(spark, where, formats.CsvReadOptions(schema=schema))
        if kind == "json":
            Frame(rows).write_json(where)
            return formats.read_json(spark, where, schema)
        if kind == "avro":
            Frame(rows).write_avro(where, formats.WriteOptions(options={"compression": "deflate"}))
            ctx = SessionContext(spark)
            ctx.register_avro("customers_of_avro", where)
            assert ctx.read_avro(where, schema="c_name string").schema().names == ["c_name"]
            return ctx.table("customers_of_avro").df
        Frame(rows).write_arrow(where)
        return formats.read_arrow(spark, where)

    run.__name__ = f"format_{kind}"
    return run


for _kind in ("parquet", "csv", "json", "arrow", "avro"):
    query("SELECT c_custkey, c_name, c_nationkey, round(c_acctbal, 2) AS c_acctbal, c_mktsegment FROM customer")(_round_trip(_kind))


@query("SELECT n_name, n_regionkey FROM nation WHERE n_regionkey < 3")
def format_dataset(spark: SparkSession, d: str) -> DataFrame:
    import pyarrow.dataset as pads

    ship(spark)
    ds = pads.dataset(f"{d}/nation.parquet", format="parquet")
    return formats.read_dataset(spark, ds, ["n_name", "n_regionkey"], pads.field("n_regionkey") < 3)


@query("SELECT c_mktsegment, count(*) AS n, max(o_totalprice) AS top FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_orderstatus = 'F' GROUP BY c_mktsegment ORDER BY c_mktsegment")
def frame_pipeline(spark: SparkSession, d: str) -> DataFrame:
    ctx = SessionContext(spark)
    c, o = ctx.read_parquet(f"{d}/customer.parquet"), ctx.read_parquet(f"{d}/orders.parquet")
    joined = c.join(o.filter("o_orderstatus = 'F'"), left_on=["c_custkey"], right_on=["o_custkey"])
    return joined.aggregate(["c_mktsegment"], [F.count(F.lit(1)).alias("n"), F.max("o_totalprice").alias("top")]).sort("c_mktsegment").df


_SESSIONS = """SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (
SELECT *, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 1 HOUR THEN 1 ELSE 0 END AS fresh FROM events)) GROUP BY user_id, s"""


@query(_SESSIONS)
def window_sessions(spark: SparkSession, d: str) -> DataFrame:
    return session_totals(table(spark, d, "events"), "ts", "value", ["user_id"], "1 hour").select("user_id", F.col("window.start").alias("start"), "n")


@query("""SELECT event_type, date_trunc('hour', ts) AS start, count(*) AS n, round(sum(value), 4) AS total FROM events
WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events) GROUP BY 1, 2""")
def stream_window_totals(spark: SparkSession, d: str) -> DataFrame:
    """The events as a stream: windows that the watermark has closed, from the files the stream wrote."""
    base = scratch_folder(spark)
    schema = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"
    table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(f"{base}/in")
    events = read_stream(spark, f"{base}/in", schema)
    run_available(window_totals(events, "ts", "value", ["event_type"], "1 hour", late="10 minutes"), f"{base}/out", f"{base}/state")
    out = spark.read.parquet(f"{base}/out")
    return out.select("event_type", F.col("window.start").cast("timestamp_ntz").alias("start"), "n", F.round("total", 4).alias("total"))


QUERIES, ORACLE = query.queries, query.sql
