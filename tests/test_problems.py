"""The general data-quality operators against small cases and brute force."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from ridgeline.operators.orphans import orphan_references
from ridgeline.operators.skew import heavy_keys, range_stitched_totals, running_totals

T = lambda d: datetime(2025, 1, d)


def ids(df):
    return sorted(r[0] for r in df.collect())


def pair_tables(spark):
    refs = spark.createDataFrame([(1, "a", 1), (2, "a", None), (3, None, 9), (4, None, None), (5, "b", 1), (5, "b", 1), (6, "", 2), (7, None, 1)], "id int, x string, y int")
    parents = spark.createDataFrame([("a", 1), ("a", 1), ("c", None), (None, 2)], "x string, y int")
    return refs, parents


@pytest.mark.parametrize(("match", "want"), [("simple", [5, 6]), ("full", [2, 3, 5, 6, 7]), ("partial", [3, 5, 6])])
def test_match_rules_with_partial_nulls(spark, match, want):
    refs, parents = pair_tables(spark)
    assert ids(orphan_references(refs, "id", ["x", "y"], parents, ["x", "y"], match=match)) == want


def test_lives(spark):
    refs = spark.createDataFrame([(1, "a", T(1)), (2, "a", T(2)), (3, "a", T(3)), (4, "a", None), (5, "a", T(9)), (6, "z", T(2)), (7, None, T(2))], "id int, k string, at timestamp")
    parents = spark.createDataFrame([("a", T(2), T(3)), ("a", T(5), None), ("z", None, T(8))], "k string, b timestamp, e timestamp")
    assert ids(orphan_references(refs, "id", ["k"], parents, ["k"], ref_time="at", alive_from="b", alive_to="e")) == [1, 3, 6]


def test_hot_key_is_salted_with_the_same_result(spark):
    refs = spark.range(30_000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 500)).alias("k"), F.col("id").alias("r_salt"))
    parents = spark.createDataFrame([("hot",), *((f"k{i}",) for i in range(0, 500, 2))], "k string")
    got = orphan_references(refs, "id", ["k"], parents, ["k"])
    assert got.count() == refs.where("k != 'hot' and int(substring(k, 2)) % 2 = 1").count()
    assert orphan_references(refs, "id", ["k"], parents.where("k != 'hot'"), ["k"]).where("r_id % 3 = 0").count() == 10_000


def test_empty_sides_and_wrong_arguments(spark):
    refs, parents = pair_tables(spark)
    assert ids(orphan_references(refs, "id", ["x"], parents.limit(0), ["x"])) == [1, 2, 5, 6]
    assert ids(orphan_references(refs.limit(0), "id", ["x"], parents, ["x"])) == []
    for bad in ({"match": "none"}, {"ref_time": "x"}):
        with pytest.raises(ValueError):
            orphan_references(refs, "id", ["x"], parents, ["x"], **bad)


def test_totals_count_entries_once(spark):
    rows = [(1, 10, 5, "a"), (1, 10, 5, "b"), (1, 11, None, "c"), (1, 12, -4, "d"), (2, 20, 7, "e"), (None, 30, 9, "f"), (3, None, 2, "g")]
    df = spark.createDataFrame(rows, "key int, file long, rows long, value string")
    got = {r["key"]: (r["total"], r["entries"]) for r in range_stitched_totals(df, "key", "file", "rows").collect()}
    assert got == {1: (5, 3), 2: (7, 1), 3: (2, 1)}
    assert range_stitched_totals(df.limit(0), "key", "file", "rows").count() == 0


def test_heavy_keys_are_exact(spark):
    df = spark.createDataFrame([(1, 98), (2, 2), (3, 0)], "key int, total long")
    assert ids(heavy_keys(df, "key", 0.02)) == [1, 2]
    assert ids(heavy_keys(df, "key", 0.0200001)) == [1]
    assert ids(heavy_keys(df.where("total = 0"), "key", 0.02)) == []
    assert ids(heavy_keys(df.limit(0), "key", 0.02)) == []


def test_hot_key_is_spread(spark):
    df = spark.range(20_000).select(F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id")).alias("k"), "id", F.lit(1).alias("v"))
    spread = df.repartitionByRange(8, "k", "id").where("k = 7").select(F.spark_partition_id()).distinct().count()
    assert spread >= 4
    assert {r["k"]: r["total"] for r in range_stitched_totals(df, "k", "id", "v", partitions=8).where("k = 7").collect()} == {7: 13_333 + (1 if 7 % 3 == 0 else 0)}


def test_running_totals_match_a_window(spark):
    from pyspark.sql import Window

    df = spark.range(5_000).select(F.when(F.col("id") % 2 == 0, 1).otherwise(F.col("id") % 10).alias("k"), (F.col("id") % 777).alias("o"), F.when(F.col("id") % 5 > 0, F.col("id")).alias("v"))
    w = Window.partitionBy("k").orderBy("o")
    want = sorted(map(tuple, df.withColumn("t", F.coalesce(F.sum("v").over(w), F.lit(0))).select("k", "o", "t").collect()))
    assert sorted(map(tuple, running_totals(df, "k", "o", "v", "t").select("k", "o", "t").collect())) == want
