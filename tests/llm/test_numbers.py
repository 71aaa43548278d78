"""Sampling and sketches: distributions and error bounds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgeline.llm.quantiles import Sketch, merge_sketches, percentile_sketches, sketch_percentiles
from ridgeline.llm.sample import Skips, merge_reservoirs, reservoir_sample, reservoirs, shares


def test_skips_are_uniform():
    hits = np.zeros(200)
    for seed in range(3000):
        s, slots = Skips(10, np.random.default_rng(seed)), {}
        seen = 0
        for n in (3, 50, 0, 147):
            offsets, where = s.take(n)
            slots.update(zip(where.tolist(), (offsets + seen).tolist()))
            seen += n
        assert len(slots) == 10
        hits[list(slots.values())] += 1
    assert abs(hits / 3000 - 0.05).max() < 0.02
    assert abs(hits[:100].sum() - hits[100:].sum()) < 600


def test_shares_follow_the_populations():
    rng = np.random.default_rng(1)
    got = np.array([shares([100, 300, 600], 50, rng) for _ in range(2000)])
    assert (got.sum(1) == 50).all() and abs(got.mean(0) - [5, 15, 30]).max() < 0.3
    assert shares([3, 0, 2], 50, rng) == [3, 0, 2] and shares([], 5, rng) == []
    assert sum(shares([2 * 10**9, 10**9], 40, rng)) == 40


def test_sample_is_uniform_over_uneven_pieces(spark):
    df = spark.range(0, 3000, 1, 1).unionAll(spark.range(3000, 3100, 1, 5)).withColumn("part", F.lit("x"))
    hits = np.zeros(3100)
    for seed in range(12):
        got = reservoir_sample(df, 400, seed, fan_in=2).toPandas()
        assert len(got) == 400 and got.id.nunique() == 400 and list(got.columns) == ["id", "part"]
        hits[got.id] += 1
    late = hits[3000:].sum() / 12
    assert 6 < late < 21  # 12.9 of 400 are expected of the small pieces
    assert reservoir_sample(df, 400, 3).toPandas().equals(reservoir_sample(df, 400, 3).toPandas())


def test_sample_cases(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, ""), (None, "x" * 100_000)], "slot int, part string")
    assert reservoir_sample(df, 10).count() == 4 and reservoir_sample(df.limit(0), 10).count() == 0
    with pytest.raises(ValueError):
        reservoir_sample(df, 0)


def test_pieces_that_arrive_later(spark):
    first = spark.range(0, 3000, 1, 2).withColumn("piece", F.lit(0))
    later = [spark.range(3000, 3100, 1, 3).withColumn("piece", F.lit(1)), spark.range(3100, 4100, 1, 1).withColumn("piece", F.when(F.col("id") < 3200, F.lit(None)).otherwise(2))]
    hits = np.zeros(4100)
    for seed in range(12):
        state = reservoirs(first, 300, seed)
        for i, new in enumerate(later):
            state = merge_reservoirs([merge_reservoirs(state, 300, seed=seed), merge_reservoirs(reservoirs(new, 300, seed + 100), 300, seed=seed)], 300, seed=seed + i)
        got = state.toPandas()
        assert len(got) == 300 == got.id.nunique() and set(got._population) == {4100}
        hits[got.id] += 1
    assert 205 < hits[:3000].sum() / 12 < 234 and 2 < hits[3000:3100].sum() / 12 < 14  # 219.5 and 7.3 are expected
    whole = first.unionAll(later[0]).unionAll(later[1])
    by = merge_reservoirs(reservoirs(whole, 120, 1, piece="piece"), 120, ["piece"], 1).toPandas()
    assert {(None if p != p else int(p)): (int(g._population.iloc[0]), len(g)) for p, g in by.groupby("piece", dropna=False)} == {0: (3000, 120), 1: (100, 100), None: (100, 100), 2: (900, 120)}
    clash = merge_reservoirs(reservoirs(whole.withColumnRenamed("piece", "_slot"), 5), 5)
    assert clash.count() == 5 and clash.columns == ["id", "_slot", "_reservoir", "__slot", "_population"]


def test_sketches_are_repeatable(spark):
    df = spark.range(0, 40_000, 1, 6).selectExpr("id", "id % 3 AS g", "array(rand(5) + 1, rand(6) + 2) AS v")
    read = lambda: sorted((r["g"], bytes(r["sketch"])) for r in percentile_sketches(df, ["g"], "v", once="id", k=64).collect())
    assert read() == read()


def rank_error(sorted_values, q, x):
    n = len(sorted_values)
    return max(0, np.searchsorted(sorted_values, x) / n - q, q - np.searchsorted(sorted_values, x, "right") / n)


@pytest.mark.parametrize("kind", ["normal", "ties", "sorted"])
def test_sketch_error_is_within_its_bound(kind):
    rng = np.random.default_rng(2)
    v = {"normal": rng.normal(size=200_000), "ties": rng.integers(0, 5, 200_000).astype(float), "sorted": np.arange(200_000.0)}[kind]
    parts = [Sketch(200, i) for i in range(40)]
    for s, x in zip(parts, np.array_split(v, 40)):
        for y in np.array_split(x, 7):
            s.add(y)
    whole = Sketch(200, 99)
    for s in parts:
        whole.merge(Sketch.from_bytes(s.to_bytes()))
    v.sort()
    assert whole.n == len(v) and sum(len(x) << h for h, x in enumerate(whole.levels)) == len(v)
    assert whole.rank_error() < 0.03 and sum(map(len, whole.levels)) < 1500
    for q in (0.01, 0.25, 0.5, 0.9, 0.999):
        assert rank_error(v, q, whole.quantiles([q])[0]) <= whole.rank_error(1e-6)
    assert whole.quantiles([0, 1]) == [v[0], v[-1]] and Sketch().quantiles([0.5]) == [None]


def test_sketch_cases_and_days(spark):
    nan = float("nan")
    rows = [(1, "a", None, [1.0, 2.0, None, nan, -1.0, 0.0]), (1, "a", None, [1.0, 2.0, None, nan, -1.0, 0.0]), (2, "a", None, [3.0, float("inf")]), (3, "b", 2, []), (4, "b", 2, None), (5, "c", 1, [7.0]), (None, "c", 1, [8.0]), (None, "c", 1, [8.0])]
    df = spark.createDataFrame(rows, "sketch long, g string, payload int, v array<double>")
    days = percentile_sketches(df, ["g", "payload"], "v", once="sketch")
    got = {r["g"]: (r["samples"], r["p50"], r["rank_error"]) for r in sketch_percentiles(merge_sketches(days, ["g"]), ["g"], [0.5]).collect()}
    assert got == {"a": (3, 2.0, 0.0), "c": (3, 8.0, 0.0)}
    assert percentile_sketches(df.limit(0), ["g"], "v", once="sketch").count() == 0
