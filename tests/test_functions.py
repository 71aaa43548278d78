"""Functions whose semantics differ from Spark's, on literals with known results."""

import asyncio
import datetime as dt
import math

import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from ridgeline import functions as E
from ridgeline.catalogs import CatalogProvider, SchemaProvider
from ridgeline.context import SessionContext, capacity, global_ctx
from ridgeline.dataflow import parallelize, parallelize_n
from ridgeline.frame import Frame
from ridgeline.functions import custom
from ridgeline.functions.base import pattern_of
from ridgeline.functions.scalar import arrow_name, spark_type
from ridgeline.functions.windows import over_groups, window_spec
from ridgeline.plans.ship import ship
from ridgeline.settings import RuntimeEnvBuilder, SessionConfig, SQLOptions
from ridgeline.sources import formats

A = lambda *x: F.array(*[F.lit(v) for v in x])


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]



CASES = [
    (lambda: E.concat(F.lit("a"), F.lit(None).cast("string"), F.lit("b")), "ab"),
    (lambda: E.initcap(F.lit("hello big-wORLD o'neil 2nd")), "Hello Big-World O'Neil 2nd"),
    (lambda: E.chr(F.lit(0x1F600)), "😀"),
    (lambda: E.left(F.lit("hello"), -2), "hel"), (lambda: E.right(F.lit("hello"), -2), "llo"),
    (lambda: E.strpos(F.lit("hello"), "l"), 3), (lambda: E.position(F.lit("hello"), "x"), 0),
    (lambda: E.regexp_replace(F.lit("foobarfoo"), "o+", "<\\0>"), "f<oo>barfoo"),
    (lambda: E.regexp_replace(F.lit("aXbXc"), "X", "-", "g"), "a-b-c"),
    (lambda: E.regexp_replace(F.lit("none"), "X", "-"), "none"),
    (lambda: E.regexp_match(F.lit("hello"), "(l+)(o)"), ["ll", "o"]), (lambda: E.regexp_match(F.lit("hello"), "z"), None),
    (lambda: E.regexp_match(F.lit("HELLO"), "l+", "i"), ["LL"]),
    (lambda: E.regexp_count(F.lit("abcabc"), "abc", 2), 1), (lambda: E.regexp_instr(F.lit("abcabc"), "b", 1, 2), 5), (lambda: E.regexp_instr(F.lit("abc"), "z"), 0),
    (lambda: E.encode(F.lit("a"), "base64"), "YQ"), (lambda: E.encode(F.lit("a"), "hex"), "61"), (lambda: bytesof(E.decode(F.lit("YQ"), "base64")), "a"), (lambda: bytesof(E.decode(F.lit("61"), "hex")), "a"),
    (lambda: F.lower(F.hex(E.digest(F.lit(""), "md5"))), "d41d8cd98f00b204e9800998ecf8427e"), (lambda: F.octet_length(E.sha384(F.lit("x"))), 48),
    (lambda: E.string_to_array(F.lit("a.b.o"), ".", "o"), ["a", "b", None]), (lambda: E.string_to_array(F.lit(""), "."), []),
    (lambda: E.gcd(F.lit(-48), F.lit(36)), 12), (lambda: E.gcd(F.lit(0), F.lit(0)), 0), (lambda: E.lcm(F.lit(4), F.lit(6)), 12), (lambda: E.lcm(F.lit(0), F.lit(6)), 0),
    (lambda: E.trunc(F.lit(-3.789), 2), -3.78), (lambda: E.ceil(F.lit(1.2)), 2.0), (lambda: E.ln(F.lit(0)), -math.inf), (lambda: E.div(F.lit(-7), F.lit(2)), -3), (lambda: E.div(F.lit(7), F.lit(0)), None),
    (lambda: E.isnan(F.lit(None).cast("double")), None), (lambda: E.iszero(F.lit(0.0)), True),
    (lambda: E.array_remove(A(1, 2, 2, 3), 2), [1, 2, 3]), (lambda: E.array_remove_n(A(2, 2, 2, 3), 2, 2), [2, 3]), (lambda: E.array_remove_all(A(1, 2, 2), 2), [1]),
    (lambda: E.array_replace(A(1, 2, 2), 2, 9), [1, 9, 2]), (lambda: E.list_replace_n(A(2, 2, 2), 2, 9, 2), [9, 9, 2]), (lambda: E.array_replace_all(A(1, 2, None), None, 9), [1, 2, 9]),
    (lambda: E.array_sort(A(3, None, 1), True, True), [None, 3, 1]), (lambda: E.array_sort(A(3, None, 1)), [1, 3, None]),
    (lambda: E.array_slice(A(1, 2, 3, 4, 5), 2, 4), [2, 3, 4]), (lambda: E.array_slice(A(1, 2, 3, 4, 5), -3, -1), [3, 4, 5]), (lambda: E.array_slice(A(1, 2, 3, 4, 5), 1, 5, 2), [1, 3, 5]), (lambda: E.array_slice(A(1, 2), 3, 9), []),
    (lambda: E.array_element(A(1, 2), 0), None), (lambda: E.array_element(A(1, 2), -1), 2), (lambda: E.array_element(A(1, 2), 5), None),
    (lambda: E.array_position(A(1, 2, 1), 1, 2), 3), (lambda: E.array_position(A(1), 7), None), (lambda: E.array_positions(A(1, None, 1), 1), [1, 3]),
    (lambda: E.array_pop_back(A(1, 2)), [1]), (lambda: E.array_pop_front(A(1)), []), (lambda: E.array_resize(A(1), 3, 0), [1, 0, 0]), (lambda: E.array_resize(A(1, 2, 3), 2), [1, 2]),
    (lambda: E.range(0, 5, 2), [0, 2, 4]), (lambda: E.range(5, 5), []), (lambda: E.gen_series(3, 1, -1), [3, 2, 1]), (lambda: E.generate_series(3, 1), []),
    (lambda: E.array_has_any(A(1, None), A(2, None)), False), (lambda: E.array_has_all(A(1, 2), A(2)), True), (lambda: E.array_any_value(A(None, 3)), 3), (lambda: E.array_normalize(A(3.0, 4.0)), [0.6, 0.8]), (lambda: E.array_normalize(A(0.0, 0.0)), None),
    (lambda: E.array_distance(A(0.0, 0.0), A(3.0, 4.0)), 5.0), (lambda: E.squared_l2(A(1.0), A(3.0)), 4.0), (lambda: E.dot_product(A(1.0, 2.0), A(3.0, 4.0)), 11.0), (lambda: E.cosine_distance(A(0.0), A(1.0)), None),
    (lambda: E.element_at(F.create_map(F.lit("a"), F.lit(1)), "b"), [None]), (lambda: E.list_to_string(A(1, None, 3), ","), "1,3"),
    (lambda: E.date_part("dow", F.lit(dt.datetime(2024, 6, 2))), 0), (lambda: E.to_char(F.lit(dt.datetime(2024, 6, 2, 3, 4, 5)), "%Y-%m-%d at %H:%M"), "2024-06-02 at 03:04"),
    (lambda: E.to_date(F.lit("02/06/2024"), "%Y-%m-%d", "%d/%m/%Y"), dt.date(2024, 6, 2)), (lambda: E.to_unixtime(F.lit("1970-01-01 00:01:00")), 60),
    (lambda: F.unix_micros(E.date_bin(900, F.lit("1999-12-31 23:59:00").cast("timestamp"), "2000-01-01")), 946683900000000),
    (lambda: E.union_extract(E.union_value("b", a=F.lit(1), b=F.lit(2)), "b"), 2), (lambda: E.arrow_typeof(F.lit(1.5)), "Float64"), (lambda: E.arrow_cast(F.lit("7"), "Int32"), 7), (lambda: E.arrow_try_cast(F.lit("x"), "Int32"), None),
]


def bytesof(c):
    return F.decode(c, "UTF-8")


def test_scalar_functions(spark):
    cols = [make().alias(f"c{i}") for i, (make, _) in enumerate(CASES)]
    got = []
    for at in range(0, len(cols), 20):
        got += list(spark.range(1).select(*cols[at : at + 20]).first())
    for (_, want), value in zip(CASES, got):
        assert value == (pytest.approx(want) if isinstance(want, float) and math.isfinite(want) else want)


def test_errors(spark):
    for bad in (E.inner_product(A(1.0), A(1.0, 2.0)), E.to_date(F.lit("nope"), "%Y")):
        with pytest.raises(Exception):  # noqa: B017
            one(spark, bad)
    for call in (lambda: E.encode(F.lit("x"), "rot13"), lambda: E.digest(F.lit("x"), "blake3"), lambda: pattern_of("%Q"), lambda: window_spec(units="groups"), lambda: capacity("lots")):
        with pytest.raises(ValueError):
            call()
    with pytest.raises(AttributeError):
        E.no_such_function  # noqa: B018


def test_names():
    assert spark_type("List(Decimal128(10, 2))") == "array<decimal(10,2)>" and arrow_name("array<bigint>") == "List(Int64)" and pattern_of("%Y'%m %%") == "yyyy''''MM %"
    assert capacity("1.5G") == 3 << 29 and capacity("64K") == 65536 and capacity("100") == 100
    assert len(E.names()) > 150 and all(getattr(E, n) for n in E.names())


def test_aggregates_keep_nulls_and_order(spark):
    df = spark.createDataFrame([("a", None, 2), ("a", 1, 3), ("a", 5, 1), ("b", None, 1)], "g string, v int, o int")
    got = {r["g"]: r for r in df.groupBy("g").agg(E.array_agg("v", order_by=["o"]).alias("all"), E.array_agg("v", filter=F.col("v") > 1).alias("f"), E.first_value("v", order_by="o").alias("first"), E.last_value("v", order_by="o").alias("last"), E.nth_value("v", 2, "o").alias("second"), E.first_value("v", order_by="o", ignore_nulls=True).alias("known"), E.string_agg("v", "-", order_by="o").alias("s"), E.approx_median("v").alias("m")).collect()}
    assert tuple(got["a"])[1:] == ([5, None, 1], [5], 5, 1, None, 5, "5-1", 3.0)
    assert tuple(got["b"])[1:] == ([None], [], None, None, None, None, "", None)


def test_groups_frame(spark):
    df = spark.createDataFrame([("x", 1), ("x", 1), ("x", 2), ("x", 5), ("y", 9)], "rank string, n int")
    got = over_groups(df, "c", F.count("*"), ["rank"], ["n"], -1, 0).orderBy("rank", "n").select("c").collect()
    assert [r[0] for r in got] == [2, 2, 3, 2, 1]


def test_user_functions(spark):
    ship(spark)
    ctx = SessionContext(spark)
    rows = [("a", "xx"), ("a", "yyyy"), ("b", None), (None, "z"), ("a", None)] * 40
    frame = Frame(spark.createDataFrame(rows, "g0 string, state string").repartition(5))
    class Longest(custom.Accumulator):
        def __init__(self):
            self.best = ""

        def update(self, values):
            for v in values.drop_null().to_pylist():
                self.best = max(self.best, v, key=lambda x: (len(x), x))

        def state(self):
            return self.best.encode()

        def merge(self, states):
            self.update(pa.array([s.decode() for s in states]))

        def evaluate(self):
            return self.best or None

    ctx.register_udaf("longest", Longest, "string")
    assert sorted(((r["g0"] or "", r["x"] or "") for r in ctx.aggregate_with(frame, "longest", ["g0"], ["state"], "x").to_pylist())) == [("", "z"), ("a", "yyyy"), ("b", "")]
    assert ctx.aggregate_with(frame, "longest", [], ["state"], "x").to_pylist() == [{"x": "yyyy"}]
    frame.into_view("words")
    assert sorted((r["g0"] or "", r["x"] or "") for r in ctx.sql("SELECT g0, longest(state) AS x FROM words GROUP BY g0").to_pylist()) == [("", "z"), ("a", "yyyy"), ("b", "")]
    assert ctx.sql("SELECT longest(s) OVER (ORDER BY i ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS x FROM VALUES (1, 'aa'), (2, 'b'), (3, 'c') AS t(i, s)").to_pydict()["x"] == ["aa", "aa", "c"]
    ctx.register_udf("twice", lambda x: pc.multiply(x, 2), "bigint", "volatile")
    assert ctx.sql("SELECT twice(id) AS y FROM range(3)").to_pydict() == {"y": [0, 2, 4]}
    ctx.register_udwf("gap", lambda t: pc.subtract(t["v"], t["v"][0]), "bigint")
    nums = ctx.from_pydict({"k": [1, 1, 2], "v": [5, 3, 7]})
    assert sorted(ctx.window_with(nums, "gap", ["k"], ["v"], "d").to_pydict()["d"]) == [0, 0, 2]

    class Framed(custom.WindowEvaluator):
        uses_window_frame = True

        def evaluate(self, values, eval_range):
            return pc.sum(values[0].slice(eval_range[0], eval_range[1] - eval_range[0])).as_py()

    class Ahead(custom.WindowEvaluator):
        supports_bounded_execution = True

        def get_range(self, idx, num_rows):
            return idx, min(idx + 2, num_rows)

        def evaluate(self, values, eval_range):
            return values[0][eval_range[1] - 1]

    class Peers(custom.WindowEvaluator):
        include_rank = True

        def evaluate_all_with_rank(self, num_rows, ranks_in_partition):
            return pa.array([b - a for a, b in ranks_in_partition for _ in range(a, b)])

    class Whole(custom.WindowEvaluator):
        def evaluate_all(self, values, num_rows):
            return pa.array([num_rows] * num_rows)

    more = ctx.from_pydict({"k": [1, 1, 1, 1], "v": [5, 3, 3, 8]})
    for kind, bounds, want in ((Framed, (-1, 0), [3, 6, 8, 13]), (Framed, (None, None), [19] * 4), (Ahead, (None, 0), [3, 5, 8, 8]), (Peers, (None, 0), [2, 2, 1, 1]), (Whole, (None, 0), [4] * 4)):
        ctx.register_udwf("w", kind, "bigint", ["v"], bounds)
        assert ctx.window_with(more, "w", ["k"], ["v"], "d").sort("v", "d").to_pydict()["d"] == sorted(want[:2]) + want[2:], kind
    ctx.deregister_udf("twice")
    with pytest.raises(Exception):  # noqa: B017
        ctx.sql("SELECT twice(1)").collect()


def test_frames(spark, tmp_path):
    ship(spark)
    ctx = SessionContext(spark)
    f = ctx.from_pylist([{"id": 1, "xs": [1, 2], "ys": ["a"]}, {"id": 2, "xs": None, "ys": []}], "t")
    assert f.unnest_columns("xs").count() == 3 and f.unnest_columns("xs", preserve_nulls=False).count() == 2
    assert [(r["xs"], r["ys"]) for r in f.unnest_columns("xs", "ys", preserve_nulls=False).sort("xs").to_pylist()] == [(1, "a"), (2, None)]
    assert ctx.table("t").limit(1, 1).count() == 1 and ctx.table_exist("t") and f.tail(1).count() == 1
    assert f.join(ctx.from_pydict({"id": [2, 3]}), "id", "anti").to_pydict()["id"] == [1]
    assert ctx.sql("SELECT :a + 1 AS x", {"a": 1}).to_pylist() == [{"x": 2}] and ctx.sql("SELECT count(*) AS n FROM {q}", q=f).to_pylist() == [{"n": 2}]
    for bad, option in (("CREATE TABLE z (a int)", {"allow_ddl": False}), ("WITH c AS (SELECT 1 AS a) INSERT INTO t SELECT a FROM c", {"allow_dml": False}), ("SET a=1", {"allow_statements": False}), ("CACHE TABLE t", {"allow_statements": False})):
        with pytest.raises(PermissionError):
            ctx.sql_with_options(bad, **option)
    assert ctx.sql_with_options("SELECT :a AS x", SQLOptions().with_allow_ddl(False), {"a": 1}).count() == 1
    assert sum(b.num_rows for p in f.collect_partitioned() for b in p) == 2 and sum(b.num_rows for b in f.execute_stream()) == 2
    nums = ctx.from_pydict({"a": [3, None, 1]})
    assert nums.sort("a").to_pydict()["a"] == [None, 1, 3] and nums.sort_by("a").to_pydict()["a"] == [1, 3, None] and nums.fill_null(0).to_pydict()["a"] == [3, 0, 1]
    nums.write_arrow(str(tmp_path / "arrow"))
    nums.write_arrow(str(tmp_path / "arrow"), formats.WriteOptions(mode="append"))
    assert sorted(ctx.read_arrow(str(tmp_path / "arrow")).fill_null(0).to_pydict()["a"]) == [0, 0, 1, 1, 3, 3]
    with pytest.raises(FileExistsError):
        nums.write_arrow(str(tmp_path / "arrow"))
    ctx.register_arrow("back", str(tmp_path / "arrow"))
    assert ctx.table("back").count() == 6 and "Scan" in ctx.table("t").explain() and nums.schema().names == ["a"]


def test_fill_null_keeps_nan_and_types(spark):
    f = SessionContext(spark).from_arrow(pa.table({"x": [float("nan"), None], "n": pa.array([None, 2], pa.int32()), "s": [None, "a"], "b": [None, True]}))
    got = f.fill_null(7).to_pydict()
    assert got["x"][0] != got["x"][0] and got["x"][1] == 7.0 and got["n"] == [7, 2] and got["s"] == [None, "a"]
    assert f.fill_null("-").to_pydict()["s"] == ["-", "a"] and f.fill_null(False, ["b"]).to_pydict()["b"] == [False, True] and f.fill_null(1, ["n"]).to_pydict()["x"][1] is None


def test_dataset_keeps_the_keys_of_its_folders(spark, tmp_path):
    import pyarrow.dataset as pads

    ship(spark)
    t = pa.table({"k": ["a", "a", "b"], "v": [1, 2, 3]})
    pads.write_dataset(t, tmp_path / "d", format="parquet", partitioning=pads.partitioning(pa.schema([("k", pa.string())]), flavor="hive"))
    ds = pads.dataset(tmp_path / "d", format="parquet", partitioning="hive")
    ctx = SessionContext(spark)
    ctx.register_dataset("folders", ds)
    assert sorted((r["k"], r["v"]) for r in ctx.table("folders").to_pylist()) == [("a", 1), ("a", 2), ("b", 3)]
    assert formats.read_dataset(spark, ds, ["v"], pads.field("k") == "b").toArrow().to_pydict() == {"v": [3]}
    assert formats.read_dataset(spark, ds, ["k"], pads.field("v") > 9).count() == 0


def test_avro_keeps_types(spark, tmp_path):
    schema = "b boolean, i int, l bigint, f float, d double, s string, x binary, y date, t timestamp, n timestamp_ntz, c decimal(20,3), a array<int>, m map<string,double>, r struct<u:string,v:array<bigint>>"
    day, at = dt.date(1969, 12, 30), dt.datetime(1969, 12, 31, 23, 59, 59, 123456)
    import decimal

    full = (True, -5, 1 << 60, 0.5, -1e300, "ä€", b"\x00\xff", day, at, at, decimal.Decimal("-12345678901234567.125"), [1, None, -3], {"k": 1.5, "z": None}, ("w", [1 << 40, None]))
    df = spark.createDataFrame([full, (None,) * len(full), (False, 0, 0, 0.0, 0.0, "", b"", day, at, at, decimal.Decimal(0), [], {}, (None, []))], schema)
    for codec in ("null", "deflate", "zstandard"):
        Frame(df).write_avro(str(tmp_path / codec), formats.WriteOptions(options={"compression": codec}))
        back = formats.read_avro(spark, str(tmp_path / codec))
        assert back.schema.simpleString() == df.schema.simpleString() and sorted(map(repr, back.collect())) == sorted(map(repr, df.collect()))
    with pytest.raises(FileExistsError):
        Frame(df).write_avro(str(tmp_path / "null"))
    with pytest.raises(FileNotFoundError):
        formats.read_avro(spark, str(tmp_path / "nothing"))


def test_plans_and_streams(spark):
    ctx = SessionContext(spark)
    f = Frame(spark.range(0, 1000, 1, 4)).aggregate([(F.col("id") % 7).alias("g")], [F.sum("id").alias("s")])
    plan = f.logical_plan()
    assert plan.name() == "Aggregate" and [p.name() for p in plan.inputs()] == ["Range"] and "Aggregate" in plan and "->" in plan.display_graphviz() and plan == f.logical_plan() and "Range" in f.optimized_logical_plan().display_indent()
    assert ctx.create_dataframe_from_logical_plan(plan).count() == 7 == ctx.execute_logical_plan(plan).count()
    physical = f.execution_plan()
    figures = physical.run()
    assert figures.output_rows > 7 and figures.spilled_bytes == 0 == figures.spill_count and figures.elapsed_compute is not None and figures.sum_by_name("shuffleBytesWritten") > 0 and figures.sum_by_name("nothing") is None
    assert any(n == "HashAggregate" and m.output_rows == 7 for n, m in physical.collect_metrics()) and physical.partition_count >= 1 and "HashAggregate" in physical
    assert sum(b.num_rows for b in ctx.execute(physical)) == 7 and len(Frame(spark.range(0, 40, 1, 4)).execute_stream_partitioned()) == 4
    assert [b.num_rows for b in ctx.execute(Frame(spark.range(0, 40, 1, 4)).execution_plan(), 2)] == [10]

    async def read():
        return sum([b.num_rows async for b in Frame(spark.range(20_000)).execute_stream()])

    assert asyncio.run(read()) == 20_000
    text = Frame(spark.range(3)).default_str_repr(2)
    assert text.splitlines()[1] == "| id |" and text.endswith("more rows follow")
    d = {r["describe"]: r["v"] for r in ctx.from_pydict({"v": [1.0, 2.0, None, 6.0]}).describe().to_pylist()}
    assert (d["count"], d["null_count"], d["mean"], d["min"], d["max"], d["median"]) == (3, 1, 3, 1, 6, 2)


def test_settings_catalogs_and_locations(spark, tmp_path):
    ship(spark)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    config = SessionConfig().with_target_partitions(5).with_batch_size(5000).with_parquet_pruning().with_repartition_joins(False).with_repartition_file_min_size(1 << 20).with_default_catalog_and_schema("spark_catalog", "default").set("spark.x", True)
    ctx = SessionContext(spark, config)
    assert spark.conf.get("spark.sql.shuffle.partitions") == "5" and ctx.copied_config()["spark.x"] == "true"
    spark.conf.set("spark.sql.shuffle.partitions", old)
    for k in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize", "spark.sql.adaptive.skewJoin.enabled", "spark.sql.files.openCostInBytes"):
        spark.conf.unset(k)
    with pytest.raises(ValueError):
        SessionConfig().with_batch_size(0)
    env = RuntimeEnvBuilder().with_disk_manager_specified("/a", "/b").with_greedy_memory_pool(2 << 30)
    assert env.options == {"spark.local.dir": "/a,/b", "spark.executor.memory": "2048m", "spark.memory.fraction": "0.8"}
    assert global_ctx() is global_ctx() and global_ctx().spark is spark
    schema, provider = SchemaProvider(), CatalogProvider()
    schema.register_table("t", pa.table({"a": [1, 2, 3]}))
    provider.register_schema("s", schema)
    ctx.register_catalog_provider("mine", provider)
    ctx.register_table_provider("plain", pa.table({"a": [5]}))
    assert "mine" in ctx.catalog_names() and "spark_catalog" in ctx.catalog_names() and ctx.catalog("mine").schema_names() == {"s"} and ctx.catalog("mine").schema("s").table("t").schema.names == ["a"]
    assert ctx.sql("SELECT sum(x.a) AS s, 'mine.s.t' AS n FROM mine.s.t x JOIN mine.s.t y ON x.a = y.a").to_pylist() == [{"s": 6, "n": "mine.s.t"}] and ctx.table("mine.s.t").count() == 3 and ctx.table("plain").count() == 1
    with pytest.raises(ValueError, match="has tables"):
        provider.deregister_schema("s")
    provider.deregister_schema("s", True)
    with pytest.raises(KeyError):
        ctx.table("mine.s.t")
    assert "default" in ctx.catalog().schema_names() and ctx.catalog().schema("default").table_names() is not None
    assert any(r["table_name"] == "plain" for r in ctx.information_schema().to_pylist()) and ctx.information_schema("columns").filter("table_name = 'plain'").to_pydict()["data_type"] == ["bigint"] and ctx.information_schema("df_settings").count() > 50
    ctx.from_pydict({"a": [1]}).write_parquet(str(tmp_path / "x.parquet"))
    assert ctx.enable_url_table().table_of(str(tmp_path / "x.parquet")).count() == 1
    with pytest.raises(ValueError, match="not known"):
        ctx.table_of("/a/b.xyz")


def test_dataflow(spark):
    flow = parallelize_n(spark, list(range(10)), 3)
    assert flow.num_partitions() == 3 and flow.map(lambda x: x * 2).collect() == [x * 2 for x in range(10)]
    by = flow.flat_map(lambda x: [x, -x]).partition_by(4, abs).collect_partitions()
    assert [sorted(set(map(abs, p))) for p in by] == [[0, 4, 8], [1, 5, 9], [2, 6], [3, 7]]
    assert parallelize(spark, [[1], [2, 3]], "serial").flatten().collect_partitions() == [[1, 2, 3]]
    assert flow.map_partitions(lambda rows: [sum(rows)]).collect() == [3, 12, 30]
    for bad in (lambda: parallelize(spark, [], "gpu"), lambda: parallelize_n(spark, [], 0), lambda: flow.partition_by(0, abs)):
        with pytest.raises(ValueError):
            bad()


def test_streams_resume(spark, tmp_path):
    from ridgeline.streaming.windows import read_stream, run_available, window_totals

    ship(spark)
    rows = [(i, dt.datetime(2024, 1, 1, i // 60, i % 60), 1.0) for i in range(300)]
    schema = "id bigint, ts timestamp, v double"
    df = spark.createDataFrame(rows, schema)
    df.where("id < 150").unionAll(df.where("id < 10")).write.parquet(str(tmp_path / "in/a"))
    go = lambda: run_available(window_totals(read_stream(spark, f"{tmp_path}/in/*", schema), "ts", "v", [], "1 hour", late="5 minutes", once=["id"]), f"{tmp_path}/out", f"{tmp_path}/state")
    go()
    first = spark.read.parquet(f"{tmp_path}/out").count()
    df.where("id >= 150").write.parquet(str(tmp_path / "in/b"))
    go()
    out = {r["window"]["start"].hour: r["total"] for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert first == 2 and out == {0: 60.0, 1: 60.0, 2: 60.0, 3: 60.0}
