"""Queries of the frame's verbs, the context's tables, functions and statements, collections and plan handles."""

from __future__ import annotations

import pickle

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader

from ridgeline.catalogs import CatalogProvider, SchemaProvider
from ridgeline.context import LocationInputPlugin, SessionContext, global_ctx
from ridgeline.dataflow import parallelize, parallelize_n
from ridgeline.datasets import example, write_examples
from ridgeline.frame import Frame
from ridgeline.functions import custom
from ridgeline.functions.windows import window_spec
from ridgeline.plans.lineage import scratch_folder
from ridgeline.plans.registry import Registry
from ridgeline.plans.relational import _context, _frame
from ridgeline.plans.ship import ship
from ridgeline.records import RecordBatchStream
from ridgeline.settings import RuntimeEnvBuilder, SQLOptions
from ridgeline.sources import formats
from ridgeline.vector import connect

query = Registry()


def _answers(spark: SparkSession, **found: object) -> DataFrame:
    """One row an answer, for verbs that return values to the caller."""
    return spark.createDataFrame([(k, str(v)) for k, v in found.items()], "what string, answer string")


def _sql(**sql: str) -> str:
    return " UNION ALL ".join(f"SELECT '{k}' AS what, CAST({v} AS VARCHAR) AS answer" for k, v in sql.items())


@query("""SELECT c_custkey AS id, upper(c_name) AS name, c_acctbal * 2 AS twice, c_nationkey::BIGINT AS nation, c_acctbal > 0 AS rich, rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey)::INTEGER AS place
FROM customer WHERE c_mktsegment = 'BUILDING' AND c_custkey > 10""")
def frame_columns(spark: SparkSession, d: str) -> DataFrame:
    c = _frame(spark, d, "customer").alias("c").filter("c_mktsegment = 'BUILDING'", F.col("c_custkey") > 10)
    by, nation = c.find_qualified_columns("c_custkey", "c_nationkey")
    out = c.with_column("twice", c["c_acctbal"] * 2).with_columns(rich=c.col("c_acctbal") > 0, name=F.upper(c.column("c_name"))).window(place=F.rank().over(window_spec([nation], [F.desc("c_acctbal"), by])))
    out = out.cast({"c_nationkey": "bigint"}).with_column_renamed("c_nationkey", "nation").drop("c_name", "c_mktsegment", "c_acctbal")
    return out.transform(lambda f, to: f.with_column_renamed("c_custkey", to), "id").select("id", "name", "twice", "nation", "rich", "place").df


@query("SELECT n_nationkey + 1 AS k, lower(n_name) AS n, n_regionkey % 2 = 0 AS even FROM nation")
def frame_select_exprs(spark: SparkSession, d: str) -> DataFrame:
    n = _frame(spark, d, "nation").repartition(3).repartition_by_hash("n_regionkey", num=2)
    return n.select_exprs("n_nationkey + 1 AS k", "lower(n_name) AS n", "n_regionkey").with_column("even", n.parse_sql_expr("n_regionkey % 2 = 0")).drop("n_regionkey").df


@query("SELECT * FROM (SELECT 'head' AS part, n_nationkey FROM nation ORDER BY n_nationkey LIMIT 5) UNION ALL SELECT * FROM (SELECT 'tail', n_nationkey FROM nation ORDER BY n_nationkey DESC LIMIT 3) UNION ALL SELECT * FROM (SELECT 'skip', n_nationkey FROM nation ORDER BY n_nationkey LIMIT 4 OFFSET 7)")
def frame_ends(spark: SparkSession, d: str) -> DataFrame:
    n = _frame(spark, d, "nation").select("n_nationkey").sort("n_nationkey")
    mark = lambda f, name: f.select(F.lit(name).alias("part"), "n_nationkey")
    return mark(n.head(5), "head").union(mark(n.tail(3), "tail")).union(mark(n.limit(4, 7), "skip")).df


_STATS = "unnest(['count', 'null_count', 'mean', 'std', 'min', 'max', 'median'])"


@query(f"""SELECT n.s AS "describe", n.v AS n_chars, s.v AS status FROM
(SELECT {_STATS} AS s, unnest([count(n_chars)::DOUBLE, (count(*) - count(n_chars))::DOUBLE, avg(n_chars), stddev_samp(n_chars), min(n_chars)::DOUBLE, max(n_chars)::DOUBLE, median(n_chars)]) AS v FROM documents) n JOIN
(SELECT {_STATS} AS s, unnest([count(status)::VARCHAR, (count(*) - count(status))::VARCHAR, NULL, NULL, min(status), max(status), NULL]) AS v FROM documents) s USING (s)""")
def frame_describe(spark: SparkSession, d: str) -> DataFrame:
    got = _frame(spark, d, "documents").select("n_chars", "status").describe().df
    return got.select("describe", "n_chars", "status")


@query(_sql(
    count="(SELECT count(*) FROM nation)", collect="(SELECT count(*) FROM nation)", column="(SELECT sum(n_regionkey) FROM nation)", partitioned="(SELECT sum(n_nationkey) FROM nation)", partitions="4", stream="(SELECT sum(n_nationkey) FROM nation)", streams="4",
    arrow="(SELECT max(n_name) FROM nation)", pandas="(SELECT min(n_name) FROM nation)", pylist="(SELECT count(*) FROM nation WHERE n_regionkey = 1)", pydict="(SELECT count(DISTINCT n_regionkey) FROM nation)", schema="'n_nationkey,n_name,n_regionkey'", text="'| n_name |'",
    cached="(SELECT count(*) FROM nation)", view="(SELECT count(*) FROM nation WHERE n_regionkey = 0)", explain="'true'", logical="'Project'", optimized="'true'", physical="'true'", metrics="(SELECT count(*) FROM nation)", executed="(SELECT count(*) FROM nation)"))
def frame_actions(spark: SparkSession, d: str) -> DataFrame:
    """Verbs that bring rows to the caller, on the smallest tables."""
    ctx = _context(spark, d, "nation")
    n = ctx.table("nation").select("n_nationkey", "n_name", "n_regionkey").repartition(4)
    ids = n.select("n_nationkey")
    sum_of = lambda batches: sum(pc.sum(b.column(0)).as_py() or 0 for b in batches)
    plan = ids.execution_plan()
    figures = plan.run()
    cached = n.cache()
    n.into_view("nations_of_frame")
    return _answers(
        spark, count=n.count(), collect=sum(b.num_rows for b in n.collect()), column=pc.sum(n.collect_column("n_regionkey")).as_py(), partitioned=sum_of(b for p in ids.collect_partitioned() for b in p), partitions=len(ids.collect_partitioned()), stream=sum_of(ids.execute_stream()),
        streams=len(ids.execute_stream_partitioned()), arrow=pc.max(n.to_arrow_table()["n_name"]).as_py(), pandas=n.to_pandas()["n_name"].min(), pylist=sum(r["n_regionkey"] == 1 for r in n.to_pylist()), pydict=len(set(n.to_pydict()["n_regionkey"])), schema=",".join(n.schema().names),
        text=n.select("n_name").limit(1).with_column("n_name", F.lit("x")).default_str_repr().splitlines()[1], cached=cached.count(), view=ctx.sql("SELECT count(*) AS n FROM nations_of_frame WHERE n_regionkey = 0").to_pylist()[0]["n"],
        explain=str("Exchange" in n.explain() and "Exchange" in n.explain(analyze=True)).lower(), logical=ids.logical_plan().name(), optimized=str("n_nationkey" in ids.optimized_logical_plan()).lower(), physical=str("Exchange" in plan).lower(), metrics=figures.sum_by_name("shuffleRecordsWritten"), executed=sum(b.num_rows for b in ctx.execute(plan)),
    )


@query("SELECT c_custkey, c_nationkey, round(c_acctbal, 2) AS c_acctbal FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey, c_nationkey, round(c_acctbal, 2) FROM customer WHERE c_custkey % 3 = 1")
def frame_write_table(spark: SparkSession, d: str) -> DataFrame:
    """A table by its name, appended to; written with Parquet options before."""
    ship(spark)
    rows, where, ctx = _frame(spark, d, "customer").select("c_custkey", "c_nationkey", F.round("c_acctbal", 2).alias("c_acctbal")), scratch_folder(spark), SessionContext(spark)
    rows.filter("c_custkey % 3 = 0").write_parquet_with_options(f"{where}/t", formats.ParquetWriterOptions("snappy", row_group_bytes=1 << 20, page_bytes=1 << 16, dictionary=False), formats.WriteOptions("overwrite", single_file=True))
    spark.sql("DROP TABLE IF EXISTS ridgeline_written")
    spark.sql(f"CREATE TABLE ridgeline_written USING parquet LOCATION '{where}/t'")
    rows.filter("c_custkey % 3 = 1").write_table("ridgeline_written")
    ctx.read_parquet(f"{where}/t")
    return ctx.read_table("ridgeline_written").df


@query("SELECT p.c_custkey, p.c_name, c.c_mktsegment, j.c_nationkey, a.c_acctbal, l.size FROM customer p JOIN customer c USING (c_custkey) JOIN customer j USING (c_custkey) JOIN (SELECT c_custkey, round(c_acctbal, 2) AS c_acctbal FROM customer) a USING (c_custkey) JOIN (SELECT c_custkey, c_custkey % 2 AS size FROM customer) l USING (c_custkey)")
def context_files(spark: SparkSession, d: str) -> DataFrame:
    """Each kind of file, written, registered by name and joined in SQL."""
    ship(spark)
    c, where = _frame(spark, d, "customer").with_column("c_acctbal", F.round("c_acctbal", 2)), scratch_folder(spark)
    ctx = SessionContext(spark).enable_url_table().enable_spark_functions()
    c.select("c_custkey", "c_name").write_parquet(f"{where}/p.parquet")
    c.select("c_custkey", "c_mktsegment").write_csv(f"{where}/c.csv")
    c.select("c_custkey", "c_nationkey").write_json(f"{where}/j.json")
    c.select("c_custkey", "c_acctbal").write_arrow(f"{where}/a.arrow")
    c.select("c_custkey", (F.col("c_custkey") % 2).alias("size")).write_parquet(f"{where}/l", write=formats.WriteOptions(partition_by=["size"]))
    ctx.register_parquet("cp", f"{where}/p.parquet")
    ctx.register_csv("cc", f"{where}/c.csv", options=formats.CsvReadOptions(schema="c_custkey bigint, c_mktsegment string"))
    ctx.register_json("cj", f"{where}/j.json", schema="c_custkey bigint, c_nationkey bigint")
    ctx.register_arrow("ca", f"{where}/a.arrow")
    ctx.register_listing_table("cl", f"{where}/l", ".parquet", "c_custkey bigint, size bigint")
    assert ctx.table_of(f"{where}/p.parquet").schema().names == ["c_custkey", "c_name"] and ctx.read_csv(f"{where}/c.csv").schema().names == ctx.read_json(f"{where}/c.csv", schema="c_custkey bigint, c_mktsegment string").schema().names
    assert ctx.read_arrow(f"{where}/a.arrow").schema().names == ["c_custkey", "c_acctbal"] and ctx.parse_capacity_limit("1.5K") == 1536
    return ctx.sql("SELECT cp.c_custkey, c_name, c_mktsegment, c_nationkey, c_acctbal, size FROM cp JOIN cc USING (c_custkey) JOIN cj USING (c_custkey) JOIN ca USING (c_custkey) JOIN cl USING (c_custkey)").df


@query("SELECT unnest(['arrow', 'batch', 'batches', 'pandas', 'pydict', 'pylist', 'read', 'registered', 'several', 'table', 'view']) AS source, a FROM (VALUES (1), (2)) t(a)")
def context_memory(spark: SparkSession, d: str) -> DataFrame:
    """Tables of the caller's memory."""
    ctx, t = global_ctx(), pa.table({"a": pa.array([1, 2], pa.int32())})
    b = t.to_batches()[0]
    one, two = b.slice(0, 1), b.slice(1, 1)
    ctx.register_batch("m_registered", b)
    ctx.register_record_batches("m_several", [[one], [two]])
    ctx.register_view("m_view", ctx.from_arrow(t))
    ctx.register_table("m_table", ctx.from_arrow(t))
    frames = {
        "arrow": ctx.from_arrow(t), "batch": ctx.from_arrow(b), "batches": ctx.create_dataframe([[one], [two]]), "pandas": ctx.from_pandas(t.to_pandas()), "pydict": ctx.from_pydict({"a": [1, 2]}), "pylist": ctx.from_pylist([{"a": 1}, {"a": 2}]), "read": ctx.read_batch(one).union(Frame(ctx.read_batches([[two]]).df)),
        "registered": ctx.table("m_registered"), "several": ctx.read_table("m_several"), "view": ctx.sql("SELECT * FROM m_view"), "table": ctx.table_provider("m_table"),
    }
    out = None
    for name, f in frames.items():
        rows = f.select(F.lit(name).alias("source"), F.col("a").cast("int").alias("a"))
        out = rows if out is None else out.union(rows)
    assert ctx.empty_table().count() == 0 == ctx.read_empty().count() and ctx.table_exist("m_view") and ctx.session_id() and ctx.session_start_time() and ctx.enable_ident_normalization()
    for name in ("m_registered", "m_several", "m_view", "m_table"):
        ctx.deregister_table(name)
    # A deregistered view is gone by name only.
    return out.df


class Parts(custom.Accumulator):
    """The number of values and their sum in hundredths, as text."""

    def __init__(self) -> None:
        self.n, self.total = 0, 0

    def update(self, values: pa.Array) -> None:
        self.n, self.total = self.n + len(values) - values.null_count, self.total + int(pc.sum(pc.round(pc.multiply(values, 100))).as_py() or 0)

    def state(self) -> bytes:
        return pickle.dumps((self.n, self.total))

    def merge(self, states) -> None:
        for s in states:
            n, total = pickle.loads(s)
            self.n, self.total = self.n + n, self.total + total

    def evaluate(self) -> str:
        return f"{self.n}:{self.total}"


class Between(custom.WindowEvaluator):
    """The sum over the frame of each row."""

    uses_window_frame = True

    def evaluate(self, values, eval_range):
        return pc.sum(values[0].slice(eval_range[0], eval_range[1] - eval_range[0])).as_py()


class PeerCount(custom.WindowEvaluator):
    include_rank = True

    def evaluate_all_with_rank(self, num_rows, ranks_in_partition):
        return pa.array([b - a for a, b in ranks_in_partition for _ in range(a, b)], pa.int64())


@query("""SELECT o_custkey, count(*) || ':' || sum(round(o_totalprice * 100)::BIGINT) AS parts, count(*) || ':' || sum(round(o_totalprice * 100)::BIGINT) AS again, max(o_orderkey * 2) AS twice FROM orders GROUP BY o_custkey""")
def context_functions(spark: SparkSession, d: str) -> DataFrame:
    """Functions registered by name: in SQL, by call, and in two phases."""
    ship(spark)
    ctx = _context(spark, d, "orders")
    ctx.register_udf("twice_of", lambda x: pc.multiply(x, 2), "bigint")
    ctx.register_udaf("parts_of", Parts, "string")
    in_sql = ctx.sql("SELECT * FROM (SELECT o_custkey, parts_of(o_totalprice) AS parts FROM orders GROUP BY o_custkey) JOIN (SELECT o_custkey, max(twice_of(o_orderkey)) AS twice FROM orders GROUP BY o_custkey) USING (o_custkey)")
    phases = ctx.aggregate_with(ctx.table("orders"), "parts_of", ["o_custkey"], ["o_totalprice"], "again")
    assert "twice_of" in ctx.udfs() and ctx.udafs() == ["parts_of"] and ctx.udaf("parts_of")[1] == "string" and ctx.udf("twice_of") is not None
    return in_sql.join(phases, "o_custkey").df


@query("""SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 4) AS around, count(*) OVER (PARTITION BY user_id, event_type) AS peers FROM events""")
def context_window_functions(spark: SparkSession, d: str) -> DataFrame:
    ship(spark)
    ctx = _context(spark, d, "events")
    ctx.register_udwf("around", Between, "double", ["value"], (-2, 1))
    ctx.register_udwf("peers", PeerCount, "bigint", ["value"])
    rows = ctx.table("events").select("event_id", "user_id", "event_type", "value")
    one = ctx.window_with(rows, "around", ["user_id"], ["event_id"], "around")
    assert ctx.udwfs() == ["around", "peers"] and ctx.udwf("peers")[1] == "bigint"
    out = ctx.window_with(one, "peers", ["user_id"], ["event_type"], "peers").select("event_id", F.round("around", 4).alias("around"), "peers")
    ctx.deregister_udwf("around")
    return out.df


@query("SELECT n_nationkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey < 3")
def context_catalogs(spark: SparkSession, d: str) -> DataFrame:
    """Tables of a catalog in Python, by three-part names."""
    ctx = _context(spark, d, "nation")
    schema, provider = SchemaProvider(), CatalogProvider()
    schema.register_table("regions", _frame(spark, d, "region"))
    provider.register_schema("geo", schema)
    ctx.register_catalog_provider_list({"atlas": provider})
    ctx.register_table_provider("limits", pa.table({"below": [3]}))
    atlas = ctx.catalog("atlas")
    assert "atlas" in ctx.catalog_names() and atlas.names() == {"geo"} and atlas.schema("geo").names() == {"regions"} and atlas.schema("geo").table("regions").schema.names[0] == "r_regionkey"
    assert ctx.table("atlas.geo.regions").count() == 5 and "limits" in ctx.information_schema().to_pydict()["table_name"]
    return ctx.sql("SELECT n_nationkey, x.r_name FROM nation JOIN atlas.geo.regions AS x ON n_regionkey = x.r_regionkey WHERE x.r_regionkey < (SELECT below FROM limits)").df


@query("SELECT o_orderkey, o_totalprice, o_orderkey * 3 AS thrice, 'bound' AS named FROM orders WHERE o_totalprice > 300000 AND o_orderstatus = 'F' UNION ALL SELECT -1, 0.5, -3, 'bound'")
def sql_statements(spark: SparkSession, d: str) -> DataFrame:
    """A view, an external table that rows go into, a function, a variable, a setting, and a statement run by its text."""
    ctx, where = _context(spark, d, "orders"), scratch_folder(spark)
    ctx.sql("CREATE OR REPLACE TEMPORARY VIEW large AS SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 300000 AND o_orderstatus = 'F'")
    ctx.sql("DROP TABLE IF EXISTS ridgeline_kept")
    ctx.sql(f"CREATE TABLE ridgeline_kept (o_orderkey BIGINT, o_totalprice DOUBLE) USING parquet LOCATION '{where}/kept'")
    ctx.sql("INSERT INTO ridgeline_kept SELECT * FROM large")
    ctx.sql("INSERT INTO ridgeline_kept VALUES (-1, 0.5)")
    ctx.sql("CREATE OR REPLACE TEMPORARY FUNCTION thrice(x BIGINT) RETURNS BIGINT RETURN x * 3")
    ctx.sql("DECLARE OR REPLACE VARIABLE label STRING DEFAULT 'unset'")
    ctx.sql("SET VAR label = 'bound'")
    ctx.sql("SET spark.ridgeline.mark=7")
    assert ctx.sql("DESCRIBE ridgeline_kept").to_pydict()["col_name"] == ["o_orderkey", "o_totalprice"] and ctx.sql("SET spark.ridgeline.mark").to_pydict()["value"] == ["7"] and ctx.sql("SHOW TABLES").count() > 0
    assert ctx.sql("EXPLAIN SELECT * FROM ridgeline_kept").count() == 1 and ctx.sql("EXECUTE IMMEDIATE 'SELECT count(*) AS n FROM ridgeline_kept WHERE o_orderkey < ?' USING 0").to_pydict() == {"n": [1]}
    options = SQLOptions().with_allow_ddl(False).with_allow_dml(False).with_allow_statements(False)
    return ctx.sql_with_options("SELECT o_orderkey, o_totalprice, thrice(o_orderkey) AS thrice, label AS named FROM ridgeline_kept", options).df


class _Numbers(DataSource):
    """Numbers up to an option, as a Python data source."""

    @classmethod
    def name(cls) -> str:
        return "ridgeline_numbers"

    def schema(self) -> str:
        return "i bigint"

    def reader(self, schema) -> DataSourceReader:
        top = int(self.options["top"])

        class Reader(DataSourceReader):
            def read(self, partition):
                for i in range(top):
                    yield (i,)

        return Reader()


class _Repeat:
    """A table function: a text so many times."""

    def eval(self, text: str, n: int):
        for i in range(n):
            yield text, i


@query("SELECT n_nationkey, n_name || '/' || i AS name, i AS i FROM nation, unnest(range(0, n_nationkey % 3)) u(i)")
def context_session(spark: SparkSession, d: str) -> DataFrame:
    """What a session can be told: sources, table functions, file systems, rules, plans, providers."""
    ship(spark)
    ctx = _context(spark, d, "nation")
    ctx.register_table_factory(_Numbers)
    ctx.register_udtf("repeated", _Repeat, "t string, i bigint")
    ctx.register_object_store("s3a", {"endpoint.region": "none"})
    ctx.deregister_object_store("s3a", ["endpoint.region"])
    ctx.refresh_catalogs()
    had = spark.conf.get("spark.sql.optimizer.excludedRules", "")
    assert ctx.remove_optimizer_rule("org.apache.spark.sql.catalyst.optimizer.LimitPushDown")
    spark.conf.set("spark.sql.optimizer.excludedRules", had)
    provider = CatalogProvider()
    ctx.register_catalog_provider("empty_atlas", provider)
    assert ctx.catalog("empty_atlas").names() == set() and isinstance(LocationInputPlugin().is_correct_input("x.parquet"), bool) and RuntimeEnvBuilder().with_fair_spill_pool(1 << 30).options["spark.executor.memory"] == "1024m"
    assert spark.read.format("ridgeline_numbers").option("top", 4).load().count() == 4 and "spark.master" in ctx.copied_config() and Frame(formats.read_parquet(spark, f"{d}/nation.parquet")).count() == 25
    table_of = ctx.sql("SELECT n_nationkey, r.t || '/' || r.i AS name, r.i FROM nation, LATERAL repeated(n_name, n_nationkey % 3) r")
    plan = ctx.create_dataframe_from_logical_plan(table_of.logical_plan())
    stream = ctx.execute_logical_plan(plan.logical_plan()).execute_stream()
    assert isinstance(stream, RecordBatchStream) and sum(b.num_rows for b in stream) == table_of.count()
    out = plan.select("n_nationkey", "name", "i").df
    for drop in (ctx.deregister_udf, ctx.deregister_udaf):
        drop("nothing_registered")
    ctx.register_udtf("gone", _Repeat, "t string, i bigint")
    ctx.deregister_udtf("gone")
    return out


@query("SELECT * FROM (VALUES (1, 91, 0.0::DOUBLE), (2, 74, 1.0), (4, 86, 64.0), (5, 95, 81.0)) t(document_id, popularity, dist)")
def examples_search(spark: SparkSession, d: str) -> DataFrame:
    """The example tables: a filtered search joined with the other table."""
    where = scratch_folder(spark)
    paths = write_examples(spark, where)
    with connect(spark, f"{where}/w") as session:
        docs = session.register_parquet("documents", paths["documents"])
        hits = session.dataframe(docs.search([0.0, 0.0]).where("status = 'published'").bypass_vector_index().select(["document_id"]))
        stats = example(spark, "document_stats")
        return hits.join(stats, "document_id").select("document_id", "popularity", F.col("_distance").cast("double").alias("dist"))


@query("SELECT n_regionkey % 3 AS part, count(*) AS n, sum(n_nationkey)::BIGINT AS total FROM nation GROUP BY 1")
def dataflow_partitions(spark: SparkSession, d: str) -> DataFrame:
    """Collections in partitions, of the smallest table."""
    pairs = [(r["n_nationkey"], r["n_regionkey"]) for r in _frame(spark, d, "nation").to_pylist()]
    flow = parallelize_n(spark, [pairs[:10], pairs[10:]], 2).flatten().map(lambda p: (p[0], p[1])).flat_map(lambda p: [p])
    by = flow.partition_by(3, lambda p: p[1]).map_partitions(lambda rows: (lambda r: [(r[0][1] % 3, len(r), sum(x[0] for x in r))] if r else [])(list(rows)))
    assert by.num_partitions() == 3 and len(by.collect_partitions()) == 3 and parallelize(spark, [1, 2], "serial").num_partitions() == 1
    return spark.createDataFrame(by.collect(), "part int, n bigint, total bigint")


@query("SELECT user_id, e1.event_id, e2.event_id AS other FROM events e1 JOIN events e2 USING (user_id) WHERE e1.event_type = 'error' AND e2.event_type = 'click' AND e2.ts BETWEEN e1.ts AND e1.ts + INTERVAL 30 MINUTE")
def join_interval(spark: SparkSession, d: str) -> DataFrame:
    """An equality and a range: within each user's rows."""
    e = _frame(spark, d, "events")
    a = e.filter("event_type = 'error'").select("user_id", "event_id", "ts")
    b = e.filter("event_type = 'click'").select(F.col("user_id").alias("u"), F.col("event_id").alias("other"), F.col("ts").alias("at"))
    return a.join_on(b, a["user_id"] == b["u"], b["at"] >= a["ts"], b["at"] <= a["ts"] + F.expr("INTERVAL 30 MINUTES")).select("user_id", "event_id", "other").df


QUERIES, ORACLE = query.queries, query.sql
