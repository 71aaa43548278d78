"""Queries that call each function of the engine by its name, column by column beside the SQL of the same value."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline import functions as E
from ridgeline.plans.registry import Registry
from ridgeline.plans.ship import ship
from ridgeline.sources.tables import table

query = Registry()
Cells = Sequence[tuple[str, str, Callable[[], Column]]]


def columns(name: str, of: str, key: str, cells: Cells, sql_from: str | None = None, prepare: Callable[[DataFrame], DataFrame] = lambda df: df, by: bool = False) -> None:
    """A query of ``key`` and the cells (column, SQL, Spark) over a table; ``by``: grouped by the key."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        ship(spark)
        rows, made = prepare(table(spark, d, of)), [f().alias(c) for c, _, f in cells]
        return rows.groupBy(key).agg(*made) if by else rows.select(key, *made)

    run.__name__ = name
    sql = ", ".join(f"{s} AS {c}" for c, s, _ in cells)
    query(f"SELECT {key}, {sql} FROM {sql_from or of}{f' GROUP BY {key}' if by else ''}")(run)


def each(names: str, sql: str, f: Callable[[Any], Column]) -> Cells:
    """The same cell for several names of one function."""
    return [(n, sql, lambda n=n: f(getattr(E, n))) for n in names.split()]


def big(x: int) -> Column:
    return F.lit(x).cast("bigint")


def _x(df: DataFrame) -> DataFrame:
    return df.select("c_custkey", "c_nationkey", "c_name", (F.col("c_nationkey") / F.lit(25.0)).alias("x"))


columns("functions_trigonometry", "customer", "c_custkey", [
    *[(n, f"round({n}(x), 7)", lambda n=n: F.round(getattr(E, n)("x"), 7)) for n in ("acos", "asin", "atan", "asinh", "atanh", "cos", "cosh", "sinh", "tan", "tanh")],
    ("acosh", "round(acosh(x + 1), 7)", lambda: F.round(E.acosh(F.col("x") + 1), 7)),
    ("cot", "round(cot(x + 0.5), 6)", lambda: F.round(E.cot(F.col("x") + 0.5), 6)),
    ("csc", "round(1 / sin(x + 0.5), 6)", lambda: F.round(E.csc(F.col("x") + 0.5), 6)),
    ("sec", "round(1 / cos(x), 6)", lambda: F.round(E.sec("x"), 6)),
    ("log", "round(log(3, x + 1), 7)", lambda: F.round(E.log(F.lit(3.0), F.col("x") + 1), 7)),
    ("pi", "round(pi(), 9)", lambda: F.round(E.pi(), 9)),
    ("nanvl", "CASE WHEN c_nationkey % 3 = 0 THEN -1.0::DOUBLE ELSE x END", lambda: E.nanvl(F.when(F.col("c_nationkey") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("x")), F.lit(-1.0))),
    ("rint", "CASE WHEN c_nationkey % 2 = 0 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END", lambda: E.rint(F.when(F.col("c_nationkey") % 2 == 0, 2.5).otherwise(1.4))),
    ("width_bucket", "(c_nationkey // 5 + 1)::BIGINT", lambda: E.width_bucket(F.col("c_nationkey").cast("double"), F.lit(0.0), F.lit(25.0), F.lit(5))),
], "(SELECT *, c_nationkey / 25.0 AS x FROM customer)", _x)


def _conditional(df: DataFrame) -> DataFrame:
    return df.select("c_custkey", "c_nationkey", F.when(F.col("c_nationkey") % 4 > 0, F.col("c_nationkey")).alias("n"), F.when(F.col("c_nationkey") % 5 == 0, F.lit(float("nan"))).when(F.col("c_nationkey") % 5 == 1, F.lit(None)).otherwise(F.col("c_acctbal")).alias("b"), "c_mktsegment")


columns("functions_conditional", "customer", "c_custkey", [
    *each("ifnull nvl", "coalesce(n, -1)", lambda f: f("n", F.lit(-1))),
    ("nvl2", "CASE WHEN n IS NOT NULL THEN 'set' ELSE 'null' END", lambda: E.nvl2("n", F.lit("set"), F.lit("null"))),
    ("isnan", "isnan(b)", lambda: E.isnan("b")),
    ("fill_nan", "CASE WHEN isnan(b) THEN 0.0::DOUBLE ELSE b END", lambda: E.fill_nan("b", 0.0)),
    ("fill_null", "CASE WHEN isnan(b) THEN 'nan' WHEN b IS NULL THEN 'null' ELSE 'set' END", lambda: F.when(F.isnan(E.fill_null("b", -1.0)), "nan").when(E.fill_null("b", -1.5) == -1.5, "null").otherwise("set")),
    ("is_not_null", "n IS NOT NULL", lambda: F.col("n").isNotNull()),
    ("case_", "CASE n WHEN 1 THEN 'one' WHEN 2 THEN 'two' ELSE 'many' END", lambda: E.case("n").when(1, "one").when(2, "two").otherwise("many")),
    ("case_end", "CASE c_mktsegment WHEN 'BUILDING' THEN 1 END", lambda: E.case("c_mktsegment").when("BUILDING", 1).end()),
    ("row_first", "c_custkey", lambda: E.row("c_custkey", "n")["c0"]),
    ("struct_second", "n", lambda: E.struct("c_custkey", "n")["c1"]),
    ("union_tag", "CASE WHEN n IS NULL THEN 'text' ELSE 'number' END", lambda: F.when(F.col("n").isNull(), E.union_tag(E.union_value("text", number="n", text="c_mktsegment"))).otherwise(E.union_tag(E.union_value("number", number="n", text="c_mktsegment")))),
    ("union_extract", "n", lambda: E.union_extract(E.union_value("number", number="n", text="c_mktsegment"), "number")),
    ("union_other", "CAST(NULL AS VARCHAR)", lambda: E.union_extract(E.union_value("number", number="n", text="c_mktsegment"), "text")),
    ("uuid_", "36", lambda: F.length(E.uuid())),
    ("random_", "true", lambda: (E.random() >= 0) & (E.random(7) < 1)),
    ("version_", "true", lambda: E.version().startswith("ridgeline")),
    ("kept", "n + 1", lambda: E.expression_from_bytes(E.expression_to_bytes(F.col("n") + 1))),
    ("kept_case", "CASE WHEN n BETWEEN 2 AND 9 AND NOT n IS NULL THEN 'it''s' ELSE upper(c_mktsegment) END", lambda: E.expression_from_bytes(E.expression_to_bytes(F.when(F.col("n").between(2, 9) & ~F.col("n").isNull(), "it's").otherwise(F.upper("c_mktsegment"))))),
], "(SELECT c_custkey, c_nationkey, CASE WHEN c_nationkey % 4 > 0 THEN c_nationkey END AS n, CASE c_nationkey % 5 WHEN 0 THEN 'NaN'::DOUBLE WHEN 1 THEN NULL ELSE c_acctbal END AS b, c_mktsegment FROM customer)", _conditional)


@query("SELECT p_partkey, p_size::DOUBLE AS ac, TRY_CAST(p_brand AS INTEGER) AS tc, CAST(p_size AS BIGINT) AS ct, TRY_CAST(p_name AS BIGINT) AS tt, 'Int32' AS ty, 'Utf8' AS fi, 'kg' AS me, 'List(Int32)' AS li, p_size AS wm, 'g' AS lm FROM part")
def functions_arrow(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").withColumn("p_partkey", F.col("p_partkey").cast("bigint")).withColumn("p_size", F.col("p_size").cast("int"))
    marked = p.withColumn("w", E.with_metadata("p_size", "w", {"unit": "kg"})).withMetadata("w", {"unit": "kg"}).withColumn("g", F.lit(1).alias("g", metadata={"unit": "g"}))
    return marked.select(
        "p_partkey", E.arrow_cast("p_size", "Float64").alias("ac"), E.arrow_try_cast("p_brand", "Int32").alias("tc"), E.cast_to_type(p, "p_size", "p_partkey").alias("ct"), E.try_cast_to_type(p, "p_name", "p_partkey").alias("tt"), E.arrow_typeof("p_size").alias("ty"),
        E.arrow_field(p, "p_name")["data_type"].alias("fi"), E.arrow_metadata(marked, "w", "unit").alias("me"), F.lit(E.arrow_name("array<int>")).alias("li"), E.with_metadata("w", "wm", {"unit": "kg"}), E.arrow_metadata(marked, "g", "unit").alias("lm"))


_NAME = "p_name || '  '"
columns("functions_text", "part", "p_partkey", [
    ("btrim", "trim('  ' || p_name || '  ')", lambda: E.btrim(F.concat(F.lit("  "), "p_name", F.lit("  ")))),
    ("ltrim", "ltrim('  ' || p_name || ' ')", lambda: E.ltrim(F.concat(F.lit("  "), "p_name", F.lit(" ")))),
    ("rtrim", "rtrim(' ' || p_name || '  ')", lambda: E.rtrim(F.concat(F.lit(" "), "p_name", F.lit("  ")))),
    ("find_in_set", "coalesce(list_position(['Brand#2', 'Brand#3', 'Brand#5'], p_brand), 0)::INTEGER", lambda: E.find_in_set("p_brand", F.lit("Brand#2,Brand#3,Brand#5"))),
    ("initcap", "array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')", lambda: E.initcap("p_name")),
    ("overlay", "left(p_name, 1) || 'XX' || substr(p_name, 5)", lambda: E.overlay("p_name", F.lit("XX"), 2, 3)),
    ("position_", "instr(p_name, 'e')::INTEGER", lambda: E.position("p_name", "e").cast("int")),
    ("regexp_match", "CASE WHEN regexp_matches(p_name, '(a.)([a-z]?)') THEN [regexp_extract(p_name, '(a.)([a-z]?)', 1), regexp_extract(p_name, '(a.)([a-z]?)', 2)] END", lambda: E.regexp_match("p_name", "(a.)([a-z]?)")),
    ("regexp_instr", "CASE WHEN regexp_matches(p_name, '[aeiou]') THEN length(regexp_extract(p_name, '^[^aeiou]*')) + 1 ELSE 0 END::INTEGER", lambda: E.regexp_instr("p_name", "[aeiou]").cast("int")),
    ("substr_", "substr(p_name, 3, 4)", lambda: E.substr("p_name", F.lit(3), F.lit(4))),
    ("substr_index", "split_part(p_name, ' ', 1)", lambda: E.substr_index("p_name", " ", 1)),
    *each("string_to_array string_to_list", "string_split(p_name, ' ')", lambda f: f("p_name", " ")),
    ("null_string", "list_transform(string_split(p_type, ' '), lambda w: nullif(w, 'ECONOMY'))", lambda: E.string_to_array("p_type", " ", "ECONOMY")),
    ("hex_", "lower(hex(p_name))", lambda: E.encode("p_name", "hex")),
    ("base64_", "rtrim(base64(p_name::BLOB), '=')", lambda: E.encode("p_name", "base64")),
    ("back_hex", "p_name", lambda: E.decode(E.encode("p_name", "hex"), "hex").cast("string")),
    ("back_base64", "p_name", lambda: E.decode(E.encode("p_name", "base64"), "base64").cast("string")),
    ("digest_", "md5(p_name)", lambda: E.to_hex(E.digest("p_name", "md5"))),
    ("digest_long", "sha256(p_name)", lambda: E.to_hex(E.digest("p_name", "sha256"))),
    ("sha256_", "sha256(p_name)", lambda: E.to_hex(E.sha256("p_name"))),
    ("sha224_", "'23097d223405d8228642a477bda255b32aadbce4bda0b3f7e36c9da7'", lambda: E.to_hex(E.sha224(F.lit("abc")))),
    ("sha384_", "'cb00753f45a35e8bb5a03d699ac65007272c32ab0eded1631a8b605a43ff5bed8086072ba1e7cc2358baeca134c825a7'", lambda: E.to_hex(E.sha384(F.lit("abc")))),
    ("sha512_", "'ddaf35a193617abacc417349ae20413112e6fa4e89a97ea20a9eeee64b55d39a2192992a274fc1a836ba3c23a3feebbd454d4423643ce80e2a9ac94fa54ca49f'", lambda: E.to_hex(E.sha512(F.lit("abc")))),
    ("blake_", "64", lambda: F.octet_length(E.digest("p_name", "blake2b"))),
])

columns("functions_spark_text", "part", "p_partkey", [
    ("like_", "p_name LIKE '%o%'", lambda: E.like("p_name", F.lit("%o%"))),
    ("ilike_", "p_name ILIKE '%O%'", lambda: E.ilike("p_name", F.lit("%O%"))),
    ("char_", "chr(65 + p_size % 26)", lambda: E.char((F.col("p_size") % 26 + 65).cast("bigint"))),
    ("luhn_check", "p_size % 2 = 0", lambda: E.luhn_check(F.when(F.col("p_size") % 2 == 0, "8112189876").otherwise("8112189875"))),
    ("unbase64_", "p_name", lambda: E.unbase64(F.base64(F.col("p_name").cast("binary"))).cast("string")),
    ("unhex_", "p_name", lambda: E.unhex(F.hex("p_name")).cast("string")),
    ("soundex_", "CASE WHEN p_size % 2 = 0 THEN 'R163' ELSE 'T522' END", lambda: E.soundex(F.when(F.col("p_size") % 2 == 0, "Rupert").otherwise("Tymczak"))),
    ("is_valid_utf8", "p_size % 2 = 0", lambda: E.is_valid_utf8(F.when(F.col("p_size") % 2 == 0, F.expr("x'C3A9'")).otherwise(F.expr("x'C3'")))),
    ("make_valid_utf8", "p_name || chr(65533)", lambda: E.make_valid_utf8(F.concat(F.col("p_name").cast("binary"), F.expr("x'FF'")))),
    ("parse_url", "'part-' || p_partkey", lambda: E.parse_url(F.concat(F.lit("https://x.org/p?id=part-"), F.col("p_partkey").cast("string")), F.lit("QUERY"), F.lit("id"))),
    ("try_parse_url", "CAST(NULL AS VARCHAR)", lambda: E.try_parse_url(F.concat(F.lit("inva lid://"), "p_name"), F.lit("HOST"))),
    ("url_decode", "p_name", lambda: E.url_decode(E.url_encode("p_name"))),
    ("try_url_decode", "CAST(NULL AS VARCHAR)", lambda: E.try_url_decode(F.concat(F.lit("%zz"), "p_name"))),
    ("crc32_", "CASE WHEN p_size % 2 = 0 THEN 891568578 ELSE 3421780262 END::BIGINT", lambda: E.crc32(F.when(F.col("p_size") % 2 == 0, "abc").otherwise("123456789"))),
    ("xxhash64_", "1423657621850124518::BIGINT", lambda: E.xxhash64(F.lit("abc"))),
    ("spark_cast", "p_size::VARCHAR", lambda: E.spark_cast("p_size", "string")),
    ("shiftrightunsigned", "(p_partkey >> 2)::BIGINT", lambda: E.shiftrightunsigned(F.col("p_partkey").cast("bigint"), 2)),
    ("bit_position", "(p_partkey + 1 - 1) % 32768", lambda: E.bitmap_bit_position((F.col("p_partkey") + 1).cast("bigint"))),
    ("bucket_number", "p_partkey // 32768 + 1", lambda: E.bitmap_bucket_number((F.col("p_partkey") + 1).cast("bigint"))),
    ("bitmap_ones", "(bit_count(p_size))::BIGINT", lambda: E.bitmap_count(F.unhex(F.lpad(F.hex("p_size"), 2, "0")))),
    ("shuffled", "list_sort(['x', p_name, p_brand])", lambda: F.sort_array(E.shuffle(F.array(F.lit("x"), "p_name", "p_brand")))),
    ("array_repeat_", "[p_size, p_size, p_size]", lambda: E.array_repeat("p_size", 3)),
])

_AT = "CAST(ts AS TIMESTAMP)"


def _times(df: DataFrame) -> DataFrame:
    df.sparkSession.conf.set("spark.sql.timeType.enabled", "true")
    ts = F.col("ts").cast("timestamp")
    return df.select("event_id", ts.alias("ts"), F.unix_micros(ts).alias("us"), F.date_format(ts, "yyyy-MM-dd HH:mm:ss").alias("text"))


def _ntz(c: Column) -> Column:
    return c.cast("timestamp_ntz")


columns("functions_clock", "events", "event_id", [
    *each("now current_timestamp", "true", lambda f: f() > F.lit("2020-01-01").cast("timestamp")),
    ("current_date_", "true", lambda: E.current_date() > F.lit("2020-01-01").cast("date")),
    ("current_time_", "true", lambda: F.length(E.current_time().cast("string")) >= 8),
    ("to_date_", "ts::DATE", lambda: E.to_date("text", "%Y-%m-%d %H:%M:%S")),
    ("to_timestamp_", "date_trunc('second', ts)", lambda: _ntz(E.to_timestamp("text", "%Y-%m-%d %H:%M:%S"))),
    ("to_timestamp_plain", "date_trunc('second', ts)", lambda: _ntz(E.to_timestamp("text"))),
    ("seconds_", "date_trunc('second', ts)", lambda: _ntz(E.to_timestamp_seconds(F.expr("us div 1000000")))),
    ("millis_", "date_trunc('millisecond', ts)", lambda: _ntz(E.to_timestamp_millis(F.expr("us div 1000")))),
    ("micros_", "ts", lambda: _ntz(E.to_timestamp_micros("us"))),
    ("nanos_", "ts", lambda: _ntz(E.to_timestamp_nanos(F.col("us") * 1000 + 7))),
    ("to_unixtime", "epoch_us(ts) // 1000000", lambda: E.to_unixtime("text")),
    ("from_unixtime", "date_trunc('second', ts)", lambda: _ntz(E.from_unixtime(F.expr("us div 1000000")))),
    ("to_local_time", "ts", lambda: E.to_local_time("ts")),
    ("make_time_", "CAST(make_time(hour(ts)::BIGINT, minute(ts)::BIGINT, 0) AS VARCHAR)", lambda: E.make_time(F.hour("ts"), F.minute("ts"), F.lit(0).cast("decimal(16,6)")).cast("string")),
    ("to_time_", "strftime(ts, '%H:%M:%S')", lambda: E.to_time(F.substring("text", 12, 8)).cast("string")),
    ("time_trunc_", "strftime(ts, '%H:00:00')", lambda: E.time_trunc(F.lit("HOUR"), E.to_time(F.substring("text", 12, 8))).cast("string")),
    ("make_dt_interval", "ts + INTERVAL 1 DAY + INTERVAL 2 HOUR", lambda: _ntz(F.col("ts") + E.make_dt_interval(F.lit(1), F.lit(2)))),
    ("make_interval", "ts + INTERVAL 1 MONTH", lambda: _ntz(F.col("ts") + E.make_interval(months=F.lit(1)))),
    ("next_day", "CAST(ts::DATE + ((8 - isodow(ts::DATE) - 1) % 7 + 1)::INTEGER AS DATE)", lambda: E.next_day("ts", "monday")),
    ("from_utc", "ts + INTERVAL 9 HOUR", lambda: _ntz(E.from_utc_timestamp("ts", "Asia/Tokyo"))),
    ("to_utc", "ts - INTERVAL 9 HOUR", lambda: _ntz(E.to_utc_timestamp("ts", "Asia/Tokyo"))),
], prepare=_times)


def _arrays(df: DataFrame) -> DataFrame:
    k, s = F.col("p_partkey").cast("bigint"), F.col("p_size").cast("bigint")
    none = F.lit(None).cast("bigint")
    return df.select("p_partkey", s.alias("s"), F.array(s, k % 7, none, s, big(3)).alias("a"), F.array(big(3), s, big(9)).alias("b"), F.when(k % 3 == 0, F.array().cast("array<bigint>")).when(k % 3 == 1, F.lit(None)).otherwise(F.array(none, k)).alias("e"), F.array(F.lit(3.0), F.col("p_size").cast("double")).alias("v"), F.array(F.array(s, k), F.array(big(1))).alias("nested"))


_ARRAYS = """(SELECT p_partkey, p_size::BIGINT AS s, [p_size, p_partkey % 7, NULL, p_size, 3]::BIGINT[] AS a, [3, p_size, 9]::BIGINT[] AS b, CASE p_partkey % 3 WHEN 0 THEN []::BIGINT[] WHEN 1 THEN NULL ELSE [NULL, p_partkey]::BIGINT[] END AS e,
[3.0::DOUBLE, p_size::DOUBLE] AS v, [[p_size, p_partkey], [1]]::BIGINT[][] AS nested FROM part)"""
_POS = "CASE WHEN {x} IS NULL THEN NULL ELSE list_filter(list_transform(range(1, len({x}) + 1), lambda i: CASE WHEN {x}[i] = s THEN i END), lambda i: i IS NOT NULL) END"


def _first_matches(x: str, n: int, keep: str) -> str:
    """SQL of ``x`` with its first ``n`` elements equal to s dropped or, with ``keep``, replaced."""
    seen = f"len(list_filter({x}[1:i], lambda y: y = s))"
    if keep == "drop":
        return f"list_transform(list_filter(range(1, len({x}) + 1), lambda i: {x}[i] IS DISTINCT FROM s OR {seen} > {n}), lambda i: {x}[i])"
    return f"list_transform(range(1, len({x}) + 1), lambda i: CASE WHEN {x}[i] = s AND {seen} <= {n} THEN {keep} ELSE {x}[i] END)"


columns("functions_array_search", "part", "p_partkey", [
    *each("array_any_match any_match list_any_match", "len(list_filter(b, lambda x: x > 40)) > 0", lambda f: f("b", lambda x: x > 40)),
    ("lambda_body", "list_transform(b, lambda x: x * 2 + 1)", lambda: E.array_transform("b", E.lambda_(["x"], E.lambda_var("x") * 2 + 1))),
    ("lambda_test", "list_filter(b, lambda x: x > 5)", lambda: E.list_filter("b", E.lambda_(["x"], E.lambda_var("x") > 5))),
    *each("array_has_any list_has_any arrays_overlap list_overlap", "s = 3 OR s = 9 OR s = 4", lambda f: F.when(F.col("s").isin(3, 4, 9), f(F.array("s"), F.array(big(3), big(4), big(9)))).otherwise(f(F.array("s"), F.array(big(3), big(4), big(9))))),
    *each("array_positions list_positions", _POS.format(x="a"), lambda f: F.transform(f("a", F.col("s")), lambda i: i.cast("bigint"))),
    *each("array_empty list_empty empty", "len(e) = 0", lambda f: f("e")),
    *each("array_any_value list_any_value", "list_filter(e, lambda x: x IS NOT NULL)[1]", lambda f: f("e")),
    *each("array_intersect list_intersect", "list_sort(list_distinct(list_filter(a, lambda x: x = 3 OR x = s OR x = 9)))", lambda f: F.array_sort(f("a", "b"))),
    *each("array_union list_union", "list_sort(list_distinct(list_concat(b, [s, 100])))", lambda f: F.array_sort(f("b", F.array("s", big(100))))),
    *each("array_except list_except", "list_sort(list_distinct(list_filter(b, lambda x: x <> s)))", lambda f: F.array_sort(f("b", F.array("s")))),
    *each("arrays_zip list_zip", "b[1] || '/' || s", lambda f: F.concat(F.get(f("b", F.array("s", big(1), big(2))), F.lit(0))["b"].cast("string"), F.lit("/"), F.col("s").cast("string"))),
], _ARRAYS, _arrays)

columns("functions_array_change", "part", "p_partkey", [
    *each("array_pop_back list_pop_back", "b[1:2]", lambda f: f("b")),
    *each("array_pop_front list_pop_front", "b[2:3]", lambda f: f("b")),
    *each("array_remove list_remove", _first_matches("a", 1, "drop"), lambda f: f("a", F.col("s"))),
    *each("array_remove_n list_remove_n", _first_matches("a", 2, "drop"), lambda f: f("a", F.col("s"), 2)),
    *each("array_remove_all list_remove_all", _first_matches("a", 99, "drop"), lambda f: f("a", F.col("s"))),
    *each("array_replace list_replace", _first_matches("a", 1, "-1"), lambda f: f("a", F.col("s"), big(-1))),
    *each("array_replace_n list_replace_n", _first_matches("a", 2, "-1"), lambda f: f("a", F.col("s"), big(-1), 2)),
    *each("array_replace_all list_replace_all", _first_matches("a", 99, "-1"), lambda f: f("a", F.col("s"), big(-1))),
    *each("array_sort list_sort", "list_sort(a, 'DESC', 'NULLS LAST')", lambda f: f("a", True)),
    ("sort_nulls_first", "list_sort(a, 'ASC', 'NULLS FIRST')", lambda: E.array_sort("a", nulls_first=True)),
    *each("array_repeat list_repeat", "[s, s]", lambda f: f("s", 2)),
    *each("array_normalize list_normalize", "list_transform(v, lambda x: round(x / sqrt(9.0 + s * s), 7))", lambda f: F.transform(f("v"), lambda x: F.round(x, 7))),
], _ARRAYS, _arrays)


@query(f"SELECT p_partkey, [2, 2]::INTEGER[] AS array_dims, [2, 2]::INTEGER[] AS list_dims, 2 AS array_ndims, 1 AS list_ndims, 3 AS cardinality_, CASE WHEN e IS NULL THEN NULL ELSE 1 END AS null_ndims FROM {_ARRAYS}")
def functions_array_shape(spark: SparkSession, d: str) -> DataFrame:
    df = _arrays(table(spark, d, "part"))
    return df.select("p_partkey", E.array_dims(df, "nested").alias("array_dims"), E.list_dims(df, "nested").alias("list_dims"), E.array_ndims(df, "nested").alias("array_ndims"), E.list_ndims(df, "b").alias("list_ndims"), E.cardinality(df, "nested").alias("cardinality_"), E.array_ndims(df, "e").alias("null_ndims"))


columns("functions_maps", "events", "event_id", [
    ("map_entries_", "event_type || '=' || user_id", lambda: F.array_join(F.transform(E.map_entries(F.create_map("event_type", F.col("user_id").cast("string"))), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")),
    ("map_from_arrays_", "user_id", lambda: E.map_from_arrays(F.array("event_type", F.lit("x")), F.array("user_id", big(0)))[F.col("event_type")]),
    ("map_from_entries_", "value", lambda: E.map_from_entries(F.array(F.struct("event_type", "value")))[F.col("event_type")]),
    ("str_to_map_", "user_id::VARCHAR", lambda: E.str_to_map(F.concat(F.lit("a:1,u:"), F.col("user_id").cast("string")), F.lit(","), F.lit(":"))[F.lit("u")]),
    ("element_at_", "event_type", lambda: F.get(E.element_at(E.make_map(F.lit("t"), "event_type", F.lit("u"), "event_type"), "t"), F.lit(0))),
])


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, CAST(NULL AS VARCHAR) AS none FROM events")
def functions_json_tuple(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", E.json_tuple("props", "k", "none").alias("k", "none"))


_Y, _X = "l_extendedprice", "l_quantity"
columns("functions_regression", "lineitem", "l_returnflag", [
    ("regr_intercept", f"round(regr_intercept({_Y}, {_X}), 3)", lambda: F.round(E.regr_intercept(_Y, _X), 3)),
    *[(n, f"round({n}({_Y}, {_X}) / count(*), 3)", lambda n=n: F.round(getattr(E, n)(_Y, _X) / F.count("*"), 3)) for n in ("regr_sxx", "regr_sxy", "regr_syy")],
    ("approx_median", f"round(median({_Y}), 4)", lambda: F.round(E.approx_median(_Y), 4)),
    ("approx_percentile_cont", f"round(quantile_cont({_Y}, 0.9), 4)", lambda: F.round(E.approx_percentile_cont(_Y, 0.9), 4)),
    ("filtered_percentile", f"round(quantile_cont({_Y}, 0.25) FILTER (WHERE {_X} > 10), 4)", lambda: F.round(E.approx_percentile_cont(_Y, 0.25, F.col(_X) > 10), 4)),
    ("approx_distinct", "true", lambda: F.abs(E.approx_distinct("l_partkey") / F.countDistinct("l_partkey") - 1) < 0.2),
    ("try_sum", f"round(sum({_X}), 2)", lambda: F.round(E.try_sum(_X), 2)),
    ("collect_list", "list_sort(list(l_linenumber))::INTEGER[]", lambda: F.transform(F.sort_array(E.collect_list("l_linenumber")), lambda x: x.cast("int"))),
    ("collect_set", "list_sort(list(DISTINCT l_linenumber))::INTEGER[]", lambda: F.transform(F.sort_array(E.collect_set("l_linenumber")), lambda x: x.cast("int"))),
    ("first_skipping_nulls", "min(l_partkey) FILTER (WHERE l_quantity > 25)", lambda: E.first_value(F.when(F.col("l_quantity") > 25, F.col("l_partkey")), order_by="l_partkey", ignore_nulls=True)),
], by=True)


@query("SELECT l_returnflag, round(quantile_cont(q, 0.5), 4) AS weighted FROM (SELECT l_returnflag, l_quantity AS q, unnest(range(0, l_linenumber::BIGINT)) FROM lineitem) GROUP BY l_returnflag")
def functions_weighted_percentile(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(E.approx_percentile_cont_with_weight("l_quantity", F.col("l_linenumber").cast("bigint"), 0.5), 4).alias("weighted"))


QUERIES, ORACLE = query.queries, query.sql
