"""Queries of the functions that keep Spark's names and meaning, and of statements that only SQL has."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline import functions as E
from ridgeline.plans.registry import Registry
from ridgeline.plans.relational import _context
from ridgeline.sources.tables import table

query = Registry()


@query("""SELECT event_id, CAST(ts::DATE + INTERVAL 2 MONTH AS DATE) AS am, ts::DATE + 5 AS da, ts::DATE - 5 AS ds, hour(ts)::INTEGER AS h, minute(ts)::INTEGER AS m, second(ts)::INTEGER AS s, date_diff('day', DATE '2024-01-01', ts::DATE)::INTEGER AS dd,
date_trunc('month', ts)::DATE AS tr, epoch_us(ts) AS us, epoch_us(ts) // 1000 AS ms, date_diff('day', DATE '1970-01-01', ts::DATE)::INTEGER AS ud FROM events""")
def spark_dates(spark: SparkSession, d: str) -> DataFrame:
    day, ts = F.to_date("ts"), F.col("ts").cast("timestamp")
    return table(spark, d, "events").select("event_id", F.add_months(day, 2).alias("am"), F.date_add(day, 5).alias("da"), F.date_sub(day, 5).alias("ds"), F.hour("ts").alias("h"), F.minute("ts").alias("m"), F.second("ts").alias("s"), F.date_diff(day, F.lit("2024-01-01").cast("date")).alias("dd"), F.trunc(day, "month").alias("tr"), F.unix_micros(ts).alias("us"), F.unix_millis(ts).alias("ms"), F.unix_date(day).alias("ud"))


@query("""SELECT p_partkey, bit_count(p_partkey)::INTEGER AS bc, p_partkey << 3 AS sl, p_partkey >> 2 AS sr, ~p_partkey AS bn, ((p_partkey >> 1) & 1)::INTEGER AS bg, hex(p_partkey) AS hx, bin(p_partkey) AS bi, ((p_partkey % 7) + 7) % 7 AS pm, round(exp(p_size / 50.0) - 1, 6) AS em, -p_size AS ng FROM part""")
def spark_numbers(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, d, "part").select("p_partkey", F.bit_count(k).alias("bc"), F.shiftleft(k, 3).alias("sl"), F.shiftright(k, 2).alias("sr"), F.bitwise_not(k).alias("bn"), F.bit_get(k, F.lit(1)).cast("int").alias("bg"), F.hex(k).alias("hx"), F.bin(k).alias("bi"), F.pmod(k, F.lit(7)).alias("pm"), F.round(F.expm1(F.col("p_size") / 50), 6).alias("em"), F.negative("p_size").alias("ng"))


@query("""SELECT p_partkey, base64(p_name::BLOB) AS b, sha1(p_name) AS s1, sha256(p_name) AS s2, url_encode(p_brand) AS ue, printf('%s/%d', p_brand, p_size) AS f, p_name LIKE '%o%' AS li, p_name ILIKE '%O%' AS il, repeat(' ', p_size % 3) AS sp, CASE WHEN p_size > 25 THEN 'big' ELSE 'small' END AS i, p_partkey % 3 AS mo,
CASE p_size % 3 WHEN 0 THEN 'x' WHEN 1 THEN 'y' ELSE 'z' END AS el FROM part""")
def spark_strings(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("p_name")
    return table(spark, d, "part").select("p_partkey", F.base64(n.cast("binary")).alias("b"), F.sha1(n).alias("s1"), F.sha2(n, 256).alias("s2"), F.url_encode("p_brand").alias("ue"), F.format_string("%s/%d", "p_brand", "p_size").alias("f"), n.like("%o%").alias("li"), n.ilike("%O%").alias("il"), E.space(F.col("p_size") % 3).alias("sp"), E.if_(F.col("p_size") > 25, F.lit("big"), F.lit("small")).alias("i"), E.modulus("p_partkey", 3).alias("mo"), F.elt(F.col("p_size") % 3 + 1, F.lit("x"), F.lit("y"), F.lit("z")).alias("el"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, list_contains([event_type, 'click'], 'click') AS c, list_resize([user_id], 3, user_id) AS r, [event_id, user_id, 7][2:3] AS s FROM events")
def spark_collections(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.array_contains(F.array("event_type", F.lit("click")), "click").alias("c"), F.array_repeat("user_id", 3).alias("r"), F.slice(F.array("event_id", "user_id", F.lit(7).cast("bigint")), 2, 2).alias("s"))


_NESTED = """WITH big AS (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey HAVING sum(o_totalprice) > 1000000),
ranked AS (SELECT c_mktsegment, c_custkey, total, rank() OVER (PARTITION BY c_mktsegment ORDER BY total DESC) AS place FROM big JOIN customer ON o_custkey = c_custkey)
SELECT c_mktsegment, c_custkey, round(total, 2) AS total, place FROM ranked WHERE place <= 3"""


@query(_NESTED)
def sql_nested_ctes(spark: SparkSession, d: str) -> DataFrame:
    return _context(spark, d, "orders", "customer").sql(_NESTED).df


_LATERAL = "SELECT n_name, t.c_custkey, t.c_acctbal FROM nation, LATERAL (SELECT c_custkey, c_acctbal FROM customer WHERE c_nationkey = n_nationkey ORDER BY c_acctbal DESC, c_custkey LIMIT 2) t"


@query(_LATERAL)
def sql_lateral_topk(spark: SparkSession, d: str) -> DataFrame:
    return _context(spark, d, "nation", "customer").sql(_LATERAL).df


_Q3 = """SELECT o_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, CAST(o_orderdate AS DATE) AS day FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1996-03-15' AND l_shipdate > TIMESTAMP '1995-03-15' GROUP BY o_orderkey, o_orderdate ORDER BY revenue DESC, o_orderkey LIMIT 10"""


@query(_Q3)
def sql_shipping_priority(spark: SparkSession, d: str) -> DataFrame:
    return _context(spark, d, "customer", "orders", "lineitem").sql(_Q3.replace("TIMESTAMP '", "TIMESTAMP_NTZ '")).df


_SUPPLIERS = """SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49 AND l_suppkey IS NOT NULL) OR s_acctbal = (SELECT max(s_acctbal) FROM supplier)"""


@query(_SUPPLIERS)
def sql_not_in(spark: SparkSession, d: str) -> DataFrame:
    return _context(spark, d, "supplier", "lineitem").sql(_SUPPLIERS).df


_DECIMAL = "SELECT l_returnflag, CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2))) AS DECIMAL(20,2)) AS total, CAST(min(l_shipdate) AS DATE) AS first FROM lineitem GROUP BY l_returnflag"


@query(_DECIMAL)
def sql_decimals(spark: SparkSession, d: str) -> DataFrame:
    return _context(spark, d, "lineitem").sql(_DECIMAL).df


QUERIES, ORACLE = query.queries, query.sql
