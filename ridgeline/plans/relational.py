"""One query or more for each relational operator: projection, filter, joins, aggregation, windows, set operations, nested data, SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ridgeline import functions as E
from ridgeline.context import SessionContext
from ridgeline.frame import Frame
from ridgeline.functions.windows import over_groups, window_spec
from ridgeline.plans.registry import Registry
from ridgeline.sources.tables import table

query = Registry()


def _context(spark: SparkSession, d: str, *names: str) -> SessionContext:
    """A context that knows these tables of the folder."""
    ctx = SessionContext(spark)
    for n in names:
        ctx.register_parquet(n, f"{d}/{n}.parquet")
    return ctx


def _frame(spark: SparkSession, d: str, name: str) -> Frame:
    return SessionContext(spark).read_parquet(f"{d}/{name}.parquet")


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def agg_pricing_summary(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").where("l_shipdate <= TIMESTAMP_NTZ '1998-09-02'").groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


@query("""SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = (SELECT min(r_name) FROM region) GROUP BY n_name""")
def join_star_revenue(spark: SparkSession, d: str) -> DataFrame:
    region = table(spark, d, "region")
    first = region.agg(F.min("r_name")).scalar()
    small = region.where(F.col("r_name") == first).join(table(spark, d, "nation"), F.col("r_regionkey") == F.col("n_regionkey"))
    return (
        table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(small, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))
    )


@query("SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net, upper(l_returnflag) AS flag FROM lineitem WHERE l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24 AND l_linestatus IN ('O', 'F')")
def filter_project(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").where(F.col("l_discount").between(0.05, 0.07) & (F.col("l_quantity") < 24) & E.in_list("l_linestatus", ["O", "F"])).select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"), F.upper("l_returnflag").alias("flag"))


def _join(kind: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        c = _frame(spark, d, "customer").select("c_custkey", "c_nationkey")
        o = _frame(spark, d, "orders").filter("o_totalprice > 200000").select("o_orderkey", "o_custkey")
        return c.join(o, how=kind, left_on=["c_custkey"], right_on=["o_custkey"]).df

    return run


_O = "(SELECT o_orderkey, o_custkey FROM orders WHERE o_totalprice > 200000) o"
for _name, _kind, _sql in (
    ("join_inner", "inner", f"SELECT c_custkey, c_nationkey, o_orderkey, o_custkey FROM customer JOIN {_O} ON c_custkey = o_custkey"),
    ("join_left", "left", f"SELECT c_custkey, c_nationkey, o_orderkey, o_custkey FROM customer LEFT JOIN {_O} ON c_custkey = o_custkey"),
    ("join_right", "right", f"SELECT c_custkey, c_nationkey, o_orderkey, o_custkey FROM customer RIGHT JOIN {_O} ON c_custkey = o_custkey"),
    ("join_full", "full", f"SELECT c_custkey, c_nationkey, o_orderkey, o_custkey FROM customer FULL JOIN {_O} ON c_custkey = o_custkey"),
    ("join_semi", "semi", f"SELECT c_custkey, c_nationkey FROM customer WHERE EXISTS (SELECT 1 FROM {_O} WHERE c_custkey = o_custkey)"),
    ("join_anti", "anti", f"SELECT c_custkey, c_nationkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM {_O} WHERE c_custkey = o_custkey)"),
):
    _f = _join(_kind)
    _f.__name__ = _name
    query(_sql)(_f)


@query("SELECT s_suppkey, n_nationkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey AND s_acctbal > n_nationkey * 300")
def join_on_inequality(spark: SparkSession, d: str) -> DataFrame:
    s, n = _frame(spark, d, "supplier"), _frame(spark, d, "nation")
    return s.join_on(n, s["s_nationkey"] == n["n_nationkey"], s["s_acctbal"] > n["n_nationkey"] * 300).select("s_suppkey", "n_nationkey", "n_name").df


@query("SELECT r_name, n_name FROM region CROSS JOIN nation WHERE length(r_name) > length(n_name)")
def join_cross_theta(spark: SparkSession, d: str) -> DataFrame:
    # Two fixed dimension tables of 5 and 25 rows.
    return _frame(spark, d, "region").join_on(_frame(spark, d, "nation"), F.length("r_name") > F.length("n_name")).select("r_name", "n_name").df


@query("SELECT o_orderkey, c_name FROM orders JOIN (SELECT c_custkey AS o_custkey, c_name FROM customer) c USING (o_custkey) WHERE o_orderpriority = '1-URGENT'")
def join_using(spark: SparkSession, d: str) -> DataFrame:
    c = _frame(spark, d, "customer").with_column_renamed("c_custkey", "o_custkey")
    return _frame(spark, d, "orders").filter("o_orderpriority = '1-URGENT'").join(c, "o_custkey").select("o_orderkey", "c_name").df


@query("SELECT o_orderpriority, o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total, grouping(o_orderpriority) AS g1, grouping(o_orderstatus) AS g2 FROM orders GROUP BY ROLLUP (o_orderpriority, o_orderstatus)")
def agg_rollup(spark: SparkSession, d: str) -> DataFrame:
    aggs = [F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.grouping("o_orderpriority").alias("g1"), F.grouping("o_orderstatus").alias("g2")]
    return _frame(spark, d, "orders").aggregate(["o_orderpriority", "o_orderstatus"], aggs, "rollup").df


@query("SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY CUBE (o_orderpriority, o_orderstatus)")
def agg_cube(spark: SparkSession, d: str) -> DataFrame:
    return _frame(spark, d, "orders").aggregate(["o_orderpriority", "o_orderstatus"], [F.count("*").alias("n")], "cube").df


@query("SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderpriority), (o_orderstatus), ())")
def agg_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    return _frame(spark, d, "orders").aggregate(["o_orderpriority", "o_orderstatus"], [F.count("*").alias("n")], [["o_orderpriority"], ["o_orderstatus"], []]).df


@query("""SELECT event_type, count(DISTINCT user_id) AS users, count(*) FILTER (WHERE value > 50) AS big, sum(DISTINCT CAST(user_id AS BIGINT) % 10)::BIGINT AS s, round(median(value), 6) AS med, round(quantile_cont(value, 0.9), 6) AS p90,
bit_and(event_id) AS ba, bit_or(event_id) AS bo, bit_xor(event_id) AS bx, bool_and(value >= 0) AS al, bool_or(value > 90) AS an, min(ts) AS first, max(ts) AS last FROM events GROUP BY event_type""")
def agg_functions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(
        F.countDistinct("user_id").alias("users"), E.count_star(F.col("value") > 50).alias("big"), F.sum_distinct(F.col("user_id") % 10).alias("s"), F.round(F.median("value"), 6).alias("med"), F.round(E.percentile_cont("value", 0.9), 6).alias("p90"),
        F.bit_and("event_id").alias("ba"), F.bit_or("event_id").alias("bo"), F.bit_xor("event_id").alias("bx"), F.bool_and(F.col("value") >= 0).alias("al"), F.bool_or(F.col("value") > 90).alias("an"), F.min("ts").alias("first"), F.max("ts").alias("last"))


@query("""SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS c, round(covar_pop(l_quantity, l_tax), 6) AS cp, round(covar_samp(l_quantity, l_tax), 6) AS cs, round(stddev_samp(l_quantity), 6) AS sd, round(stddev_pop(l_quantity), 6) AS sp,
round(var_samp(l_quantity), 5) AS vs, round(var_pop(l_quantity), 5) AS vp, round(regr_slope(l_extendedprice, l_quantity), 4) AS rs, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2, round(regr_avgx(l_extendedprice, l_quantity), 6) AS ax, round(regr_avgy(l_extendedprice, l_quantity), 4) AS ay, regr_count(l_extendedprice, l_quantity)::BIGINT AS rc FROM lineitem GROUP BY 1""")
def agg_statistics(spark: SparkSession, d: str) -> DataFrame:
    y, x = "l_extendedprice", "l_quantity"
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(
        F.round(F.corr(x, y), 6).alias("c"), F.round(F.covar_pop(x, "l_tax"), 6).alias("cp"), F.round(E.covar(x, "l_tax"), 6).alias("cs"), F.round(E.stddev(x), 6).alias("sd"), F.round(F.stddev_pop(x), 6).alias("sp"),
        F.round(E.var(x), 5).alias("vs"), F.round(E.var_population(x), 5).alias("vp"), F.round(F.regr_slope(y, x), 4).alias("rs"), F.round(F.regr_r2(y, x), 6).alias("r2"), F.round(F.regr_avgx(y, x), 6).alias("ax"), F.round(F.regr_avgy(y, x), 4).alias("ay"), F.regr_count(y, x).alias("rc"))


@query("""SELECT tenant_id, array_agg(status ORDER BY doc_id) AS statuses, string_agg(category, ',' ORDER BY doc_id) AS cats, arg_min(doc_id, doc_id) AS first_id, (array_agg(doc_id ORDER BY doc_id))[2] AS second_id, max(doc_id) AS last_id FROM documents GROUP BY 1""")
def agg_ordered(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy("tenant_id").agg(E.array_agg("status", order_by=["doc_id"]).alias("statuses"), E.nullif(E.string_agg("category", ",", order_by="doc_id"), F.lit("")).alias("cats"), E.first_value("doc_id", order_by="doc_id").alias("first_id"), E.nth_value("doc_id", 2, "doc_id").alias("second_id"), E.last_value("doc_id", order_by="doc_id").alias("last_id"))


@query("""SELECT event_id, row_number() OVER w AS rn, rank() OVER w AS rk, dense_rank() OVER w AS dr, round(percent_rank() OVER w, 9) AS pr, round(cume_dist() OVER w, 9) AS cd, ntile(4) OVER w AS nt, lag(event_id, 1) OVER w AS lg, lead(event_id, 2, -1) OVER w AS ld
FROM events WINDOW w AS (PARTITION BY event_type ORDER BY value, event_id)""")
def window_ranking(spark: SparkSession, d: str) -> DataFrame:
    w = window_spec(["event_type"], ["value", "event_id"])
    return table(spark, d, "events").select("event_id", F.row_number().over(w).alias("rn"), F.rank().over(w).alias("rk"), F.dense_rank().over(w).alias("dr"), F.round(F.percent_rank().over(w), 9).alias("pr"), F.round(F.cume_dist().over(w), 9).alias("cd"), F.ntile(4).over(w).alias("nt"), F.lag("event_id", 1).over(w).alias("lg"), F.lead("event_id", 2, -1).over(w).alias("ld"))


@query("""SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS s, count(*) OVER (PARTITION BY user_id ORDER BY event_id RANGE BETWEEN 500 PRECEDING AND 100 FOLLOWING) AS c,
first_value(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS f, nth_value(event_id, 2) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS n2 FROM events""")
def window_frames(spark: SparkSession, d: str) -> DataFrame:
    p, o = ["user_id"], ["event_id"]
    return table(spark, d, "events").select("event_id", F.round(F.sum("value").over(window_spec(p, o, "rows", -2, 0)), 4).alias("s"), F.count("*").over(window_spec(p, o, "range", -500, 100)).alias("c"), F.first("event_id").over(window_spec(p, o)).alias("f"), F.nth_value("event_id", 2).over(window_spec(p, o, "rows")).alias("n2"))


@query("SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY user_id GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS n FROM events")
def window_groups(spark: SparkSession, d: str) -> DataFrame:
    return over_groups(table(spark, d, "events").select("event_id", "event_type", "user_id"), "n", F.count("*"), ["event_type"], ["user_id"], -1, 1).select("event_id", "n")


_A, _B = "SELECT l_suppkey AS k FROM lineitem WHERE l_quantity > 45", "SELECT l_partkey % 120 AS k FROM lineitem WHERE l_quantity < 5"


def _set(how: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        l = _frame(spark, d, "lineitem")
        a, b = l.filter("l_quantity > 45").select(F.col("l_suppkey").alias("k")), l.filter("l_quantity < 5").select((F.col("l_partkey") % 120).alias("k"))
        return {"union_all": lambda: a.union(b), "union_distinct": lambda: a.union_distinct(b), "intersect": lambda: a.intersect(b, True), "intersect_all": lambda: a.intersect(b), "except": lambda: a.except_all(b, True), "except_all": lambda: a.except_all(b)}[how]().df

    return run


for _how in ("union_all", "union_distinct", "intersect", "intersect_all", "except", "except_all"):
    _f = _set(_how)
    _f.__name__ = f"set_{_how}"
    query(f"({_A}) {'UNION' if _how == 'union_distinct' else _how.replace('_', ' ').upper()} ({_B})")(_f)


@query("SELECT c_custkey AS id, c_name AS name, NULL AS bal FROM customer UNION ALL SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def set_union_by_name(spark: SparkSession, d: str) -> DataFrame:
    c = _frame(spark, d, "customer").select(F.col("c_name").alias("name"), F.col("c_custkey").alias("id"))
    s = _frame(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("bal"), F.col("s_name").alias("name"))
    return c.union_by_name(s).df


@query("SELECT DISTINCT p_brand, p_size % 5 AS s FROM part")
def distinct_rows(spark: SparkSession, d: str) -> DataFrame:
    return _frame(spark, d, "part").select("p_brand", (F.col("p_size") % 5).alias("s")).distinct().df


@query("SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey")
def distinct_on(spark: SparkSession, d: str) -> DataFrame:
    return _frame(spark, d, "orders").distinct_on(["o_custkey"], ["o_custkey", "o_orderkey", "o_totalprice"], [F.desc("o_totalprice"), "o_orderkey"]).df


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 10")
def sort_limit_offset(spark: SparkSession, d: str) -> DataFrame:
    return _frame(spark, d, "orders").sort(E.order_by("o_totalprice", False, False), "o_orderkey").limit(50, 10).select("o_orderkey", "o_totalprice").df


@query("SELECT doc_id, CAST(row_number() OVER (ORDER BY status ASC NULLS FIRST, category DESC NULLS LAST, doc_id) AS INTEGER) AS place FROM documents QUALIFY place <= 100")
def sort_nulls(spark: SparkSession, d: str) -> DataFrame:
    top = table(spark, d, "documents").orderBy(E.order_by("status"), E.order_by("category", False, False), "doc_id").limit(100)
    return top.select("doc_id", F.row_number().over(Window.orderBy(E.order_by("status"), E.order_by("category", False, False), "doc_id")).alias("place"))


@query("SELECT query_id, p AS field FROM (SELECT DISTINCT ON (query_id) * FROM queries), unnest(projection) AS t(p)")
def unnest_array(spark: SparkSession, d: str) -> DataFrame:
    once = _frame(spark, d, "queries").distinct_on(["query_id"], ["query_id", F.col("projection").alias("field")], ["issued_at"])
    return once.unnest_columns("field", preserve_nulls=False).df


@query("SELECT query_id, e.doc_id AS doc_id, round(e._distance, 3) AS dist FROM (SELECT DISTINCT ON (query_id) query_id, expected FROM queries), unnest(expected) AS t(e)")
def unnest_structs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "queries").dropDuplicates(["query_id"]).select("query_id", F.inline("expected")).select("query_id", "doc_id", F.round("_distance", 3).alias("dist"))


@query("SELECT query_id, e.doc_id AS doc_id FROM (SELECT DISTINCT ON (query_id) query_id, expected FROM queries) LEFT JOIN unnest(expected) AS t(e) ON true")
def unnest_preserving_nulls(spark: SparkSession, d: str) -> DataFrame:
    once = _frame(spark, d, "queries").distinct_on(["query_id"], ["query_id", F.col("expected").alias("e")], ["issued_at"])
    return once.unnest_columns("e").select("query_id", F.col("e.doc_id").alias("doc_id")).df


@query("SELECT * FROM (VALUES (1, 'a'), (2, 'b'), (3, NULL)) AS t(id, name)")
def values_relation(spark: SparkSession, d: str) -> DataFrame:
    return SessionContext(spark).sql("SELECT * FROM VALUES (1, 'a'), (2, 'b'), (3, NULL) AS t(id, name)").df


@query("WITH RECURSIVE t(n, f) AS (SELECT 1, 1::BIGINT UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 15) SELECT n, f FROM t")
def recursive_cte(spark: SparkSession, d: str) -> DataFrame:
    return SessionContext(spark).sql("WITH RECURSIVE t(n, f) AS (SELECT 1, CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 15) SELECT n, f FROM t").df


_SUB = """SELECT o_orderkey FROM orders o WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.8 FROM orders) AND EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_quantity > 40)
AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)"""


@query(_SUB)
def sql_subqueries(spark: SparkSession, d: str) -> DataFrame:
    return _context(spark, d, "orders", "lineitem", "customer").sql(_SUB).df


_CORR = "SELECT p_partkey, p_retailprice FROM part p WHERE p_retailprice = (SELECT max(q.p_retailprice) FROM part q WHERE q.p_brand = p.p_brand)"


@query(_CORR)
def sql_correlated_scalar(spark: SparkSession, d: str) -> DataFrame:
    return _context(spark, d, "part").sql(_CORR).df


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 9000 AND c_mktsegment = 'BUILDING'")
def sql_parameters(spark: SparkSession, d: str) -> DataFrame:
    return _context(spark, d, "customer").sql("SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > :least AND c_mktsegment = :segment", {"least": 9000, "segment": "BUILDING"}).df


@query("SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS class, CASE p_size WHEN 1 THEN 'one' ELSE NULL END AS one, coalesce(nullif(p_brand, 'Brand#11'), '-') AS brand, greatest(p_size, 25) AS g, least(p_size, 25) AS l FROM part")
def expr_conditional(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("p_size")
    return table(spark, d, "part").select("p_partkey", F.when(s < 10, "small").when(s < 30, "medium").otherwise("large").alias("class"), F.when(s == 1, "one").alias("one"), F.coalesce(F.nullif("p_brand", F.lit("Brand#11")), F.lit("-")).alias("brand"), F.greatest("p_size", F.lit(25)).alias("g"), F.least("p_size", F.lit(25)).alias("l"))


@query("""SELECT doc_id, status LIKE 'pub%' AS li, status ILIKE 'PUB%' AS il, regexp_matches(source, '^[a-m]') AS sim, status IS NULL AS isn, (status = 'draft') IS TRUE AS it, (status = 'draft') IS NOT TRUE AS nt, (status = 'draft') IS NOT FALSE AS nf FROM documents""")
def expr_predicates(spark: SparkSession, d: str) -> DataFrame:
    s, draft = F.col("status"), F.col("status") == "draft"
    return table(spark, d, "documents").select("doc_id", s.like("pub%").alias("li"), s.ilike("PUB%").alias("il"), F.col("source").rlike("^[a-m]").alias("sim"), s.isNull().alias("isn"), draft.eqNullSafe(True).alias("it"), (~draft.eqNullSafe(True)).alias("nt"), (~draft.eqNullSafe(False)).alias("nf"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey // 7 AS q, l_partkey % 7 AS m, CAST(l_quantity AS INTEGER) & 3 AS a, CAST(l_quantity AS INTEGER) | 8 AS o, xor(CAST(l_quantity AS INTEGER), 5) AS x, -l_quantity AS n, TRY_CAST(l_returnflag AS INTEGER) AS tc FROM lineitem""")
def expr_arithmetic(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("l_quantity").cast("int")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", E.div("l_partkey", F.lit(7)).alias("q"), (F.col("l_partkey") % 7).alias("m"), q.bitwiseAND(3).alias("a"), q.bitwiseOR(8).alias("o"), q.bitwiseXOR(5).alias("x"), (-F.col("l_quantity")).alias("n"), F.col("l_returnflag").try_cast("int").alias("tc"))


@query("""SELECT c_custkey, round(abs(c_acctbal), 2) AS ab, ceil(c_acctbal) AS ce, floor(c_acctbal) AS fl, sign(c_acctbal) AS sg, round(sqrt(abs(c_acctbal)), 6) AS sq, round(cbrt(c_acctbal), 6) AS cb, round(exp(c_nationkey / 10.0), 5) AS ex, round(ln(c_custkey), 7) AS l, round(log10(c_custkey), 7) AS lt, round(log2(c_custkey), 7) AS l2,
round(sin(c_acctbal), 5) AS si, round(atan2(c_acctbal, 7), 6) AS at, round(degrees(c_nationkey), 4) AS de, round(radians(c_nationkey), 6) AS ra, round(power(c_nationkey, 2.5), 3) AS pw, gcd(c_custkey, 36) AS g, lcm(c_custkey, 36) AS lc, trunc(c_acctbal) AS tr, factorial(c_nationkey % 15) AS fa, c_nationkey = 0 AS iz FROM customer""")
def functions_math(spark: SparkSession, d: str) -> DataFrame:
    b, k, n = F.col("c_acctbal"), F.col("c_custkey"), F.col("c_nationkey")
    return table(spark, d, "customer").select(
        "c_custkey", F.round(F.abs(b), 2).alias("ab"), E.ceil(b).alias("ce"), E.floor(b).alias("fl"), F.signum(b).cast("int").alias("sg"), F.round(F.sqrt(F.abs(b)), 6).alias("sq"), F.round(F.cbrt(b), 6).alias("cb"), F.round(F.exp(n / 10), 5).alias("ex"), F.round(E.ln(k), 7).alias("l"), F.round(E.log10(k), 7).alias("lt"), F.round(E.log2(k), 7).alias("l2"),
        F.round(F.sin(b), 5).alias("si"), F.round(F.atan2(b, F.lit(7.0)), 6).alias("at"), F.round(F.degrees(n), 4).alias("de"), F.round(F.radians(n), 6).alias("ra"), F.round(E.pow(n, F.lit(2.5)), 3).alias("pw"), E.gcd(k, F.lit(36)).alias("g"), E.lcm(k, F.lit(36)).alias("lc"), E.trunc(b).alias("tr"), F.factorial(n % 15).alias("fa"), E.iszero(n).alias("iz"))


@query("""SELECT p_partkey, upper(p_name) AS u, lower(p_type) AS lo, length(p_name) AS le, bit_length(p_name)::INTEGER AS bl, strlen(p_name)::INTEGER AS ol, reverse(p_name) AS rv, repeat(p_brand, 2) AS rp, replace(p_name, 'a', 'A') AS re, lpad(p_brand, 12, '*') AS lp, rpad(p_brand, 12, '*') AS rpd, left(p_name, 4) AS lf, right(p_name, 3) AS rt,
split_part(p_name, ' ', 2) AS sp, instr(p_name, 'e') AS ins, starts_with(p_name, 's') AS sw, ends_with(p_name, 'e') AS ew, translate(p_name, 'abc', 'xyz') AS tr, concat_ws('-', p_brand, p_type) AS cw, contains(p_name, 'ar') AS co, levenshtein(p_brand, 'Brand#11') AS lv, ascii(p_name) AS a, chr(65 + p_size % 26) AS ch, md5(p_name) AS m, substr(p_name, 2, 3) AS su, trim('  ' || p_brand || ' ') AS t, lower(to_hex(p_size)) AS h FROM part""")
def functions_string(spark: SparkSession, d: str) -> DataFrame:
    n, b = F.col("p_name"), F.col("p_brand")
    return table(spark, d, "part").select(
        "p_partkey", F.upper(n).alias("u"), F.lower("p_type").alias("lo"), E.length(n).alias("le"), F.bit_length(n).alias("bl"), F.octet_length(n).alias("ol"), F.reverse(n).alias("rv"), F.repeat(b, 2).alias("rp"), F.replace(n, F.lit("a"), F.lit("A")).alias("re"), F.lpad(b, 12, "*").alias("lp"), F.rpad(b, 12, "*").alias("rpd"), E.left(n, 4).alias("lf"), E.right(n, 3).alias("rt"),
        F.split_part(n, F.lit(" "), F.lit(2)).alias("sp"), E.strpos(n, "e").alias("ins"), E.starts_with(n, F.lit("s")).alias("sw"), E.ends_with(n, F.lit("e")).alias("ew"), F.translate(n, "abc", "xyz").alias("tr"), F.concat_ws("-", b, "p_type").alias("cw"), F.contains(n, F.lit("ar")).alias("co"), F.levenshtein(b, F.lit("Brand#11")).alias("lv"), F.ascii(n).alias("a"), E.chr(65 + F.col("p_size") % 26).alias("ch"), F.md5(n).alias("m"), F.substring(n, 2, 3).alias("su"), F.trim(F.concat(F.lit("  "), b, F.lit(" "))).alias("t"), E.to_hex("p_size").alias("h"))


@query(r"""SELECT doc_id, regexp_replace(title, '[aeiou]+', '<>') AS r1, regexp_replace(title, '[aeiou]+', '<>', 'g') AS rg, regexp_matches(title, '(?i)NOTES') AS m, len(regexp_extract_all(title, '[a-z]+'))::INTEGER AS c, coalesce(status, '') || coalesce(category, '') AS cc FROM documents""")
def functions_regex(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", E.regexp_replace("title", "[aeiou]+", "<>").alias("r1"), E.regexp_replace("title", "[aeiou]+", "<>", "g").alias("rg"), E.regexp_like("title", "NOTES", "i").alias("m"), E.regexp_count("title", "[a-z]+").alias("c"), E.concat("status", "category").alias("cc"))


@query("""SELECT event_id, date_trunc('hour', ts) AS h, year(ts)::INTEGER AS y, month(ts)::INTEGER AS m, day(ts)::INTEGER AS dd, dayofweek(ts)::INTEGER AS dow, week(ts)::INTEGER AS w, quarter(ts)::INTEGER AS q, strftime(ts, '%Y/%m/%d %H:%M') AS f, time_bucket(INTERVAL 15 MINUTE, ts, TIMESTAMP '2001-01-01') AS b, CAST(floor(epoch(ts)) AS BIGINT) AS ep, last_day(ts) AS ld, make_date(year(ts)::INTEGER, 2, 3) AS md FROM events""")
def functions_time(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("ts")
    part = lambda p: E.date_part(p, t)
    return table(spark, d, "events").select("event_id", F.date_trunc("hour", t).alias("h"), part("year").alias("y"), part("month").alias("m"), part("day").alias("dd"), part("dow").alias("dow"), part("week").alias("w"), part("quarter").alias("q"), E.to_char(t, "%Y/%m/%d %H:%M").alias("f"), E.date_bin(900, t, "2001-01-01").cast("timestamp_ntz").alias("b"), F.unix_seconds(t.cast("timestamp")).alias("ep"), F.last_day(t).alias("ld"), F.make_date(F.year(t), F.lit(2), F.lit(3)).alias("md"))


_L = "(SELECT p_partkey, [p_size, p_partkey % 7, NULL, p_size, 3]::BIGINT[] AS a, [3, p_size, 9]::BIGINT[] AS b FROM part)"


@query(f"""SELECT p_partkey, len(a)::INTEGER AS n, list_position(a, 3)::BIGINT AS pos, list_contains(a, 3) AS has, list_sort(list_distinct(a)) AS di, list_reverse(b) AS rv, list_max(a) AS mx, list_min(a) AS mn, a[2:4] AS sl, list_transform(b, lambda x: x * 2) AS tf, list_filter(b, lambda x: x > 5) AS fi, list_concat(b, b) AS cc, list_append(b, 1) AS ap, list_prepend(0, b) AS pp, array_to_string(b, ',') AS st, a[5] AS el, list_has_all(b, [3, 9]) AS ha, flatten([b, b]) AS fl, generate_series(1, p_partkey % 4) AS gs, range(0, p_partkey % 4) AS ra, list_resize(b, 5, 0) AS rs FROM {_L}""")
def functions_array(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    p = table(spark, d, "part").select("p_partkey", F.array(F.col("p_size").cast("bigint"), k % 7, F.lit(None).cast("bigint"), F.col("p_size").cast("bigint"), F.lit(3).cast("bigint")).alias("a"), F.array(F.lit(3).cast("bigint"), F.col("p_size").cast("bigint"), F.lit(9).cast("bigint")).alias("b"))
    big = lambda x: F.lit(x).cast("bigint")
    return p.select(
        "p_partkey", E.list_length("a").alias("n"), E.list_position("a", 3).alias("pos"), F.coalesce(F.array_contains("a", 3), F.lit(False)).alias("has"), F.array_sort(F.array_compact(F.array_distinct("a"))).alias("di"), F.reverse("b").alias("rv"), F.array_max("a").alias("mx"), F.array_min("a").alias("mn"), E.array_slice("a", 2, 4).alias("sl"), E.list_transform("b", lambda x: x * 2).alias("tf"), E.list_filter("b", lambda x: x > 5).alias("fi"),
        E.list_concat("b", "b").alias("cc"), E.list_append("b", big(1)).alias("ap"), E.list_prepend(big(0), "b").alias("pp"), E.list_to_string("b", ",").alias("st"), E.list_element("a", 5).alias("el"), E.list_has_all("b", F.array(big(3), big(9))).alias("ha"), F.flatten(F.array("b", "b")).alias("fl"), E.gen_series(big(1), k % 4).alias("gs"), E.range(big(0), k % 4).alias("ra"), E.list_resize("b", 5, big(0)).alias("rs"))


@query("SELECT event_id, map_keys(m) AS k, map_values(m) AS v, m['type'] AS t, cardinality(m)::INTEGER AS n FROM (SELECT event_id, MAP {'type': event_type, 'user': CAST(user_id AS VARCHAR)} AS m FROM events)")
def functions_map(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "events").select("event_id", E.make_map(F.lit("type"), "event_type", F.lit("user"), F.col("user_id").cast("string")).alias("m"))
    return m.select("event_id", F.map_keys("m").alias("k"), F.map_values("m").alias("v"), F.get(E.map_extract("m", F.lit("type")), F.lit(0)).alias("t"), F.size("m").alias("n"))


@query("SELECT event_id, struct_pack(a := user_id, b := event_type).b AS b FROM events")
def functions_struct(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", E.get_field(E.named_struct([("a", "user_id"), ("b", "event_type")]), "b").alias("b"))


@query("SELECT user_id, date_trunc('hour', ts) AS start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def window_tumbling(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "events").groupBy("user_id", F.window("ts", "1 hour")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return g.select("user_id", F.col("window.start").alias("start"), "n", "total")


@query("SELECT * FROM (PIVOT (SELECT o_orderpriority, o_orderstatus FROM orders) ON o_orderstatus IN ('F', 'O', 'P') USING count(*))")
def pivot_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1))).fillna(0)


@query("SELECT doc_id, coalesce(status, 'unknown') AS status, coalesce(category, 'unknown') AS category, coalesce(n_chars, 0) AS n_chars FROM documents")
def fill_null(spark: SparkSession, d: str) -> DataFrame:
    return _frame(spark, d, "documents").select("doc_id", "status", "category", "n_chars").fill_null("unknown").fill_null(0).df


QUERIES, ORACLE = query.queries, query.sql
