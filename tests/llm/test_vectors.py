"""Nearest vectors and clusters against brute force."""

import numpy as np
import pytest

from ridgeline.llm.clusters import Clustering, _near_clusters, _router, first_minima, local_minima, similarity_clusters
from ridgeline.llm.knn import Search, nearest_vectors, route
from ridgeline.llm.vectors import Router, judged

DIM = 16


def points(n, groups, rng, spread=1.0):
    centres = rng.normal(size=(groups, DIM)) * 10
    return (centres[rng.integers(groups, size=n)] + rng.normal(size=(n, DIM)) * spread).astype(np.float32)


def brute(x, ids, tags, q, k, want):
    d = ((x.astype(np.float64) - q) ** 2).sum(1)
    ok = np.ones(len(x), bool) if want is None else tags == want
    o = np.lexsort((ids[ok], d[ok]))[:k]
    return list(ids[ok][o])


@pytest.mark.parametrize("search", [Search(), Search(cell_rows=64, probes=48, lists_per_root_n=2)])
def test_recall(spark, search):
    rng = np.random.default_rng(4)
    x = points(3000, 40, rng)
    x[100:110] = x[99]
    tags = rng.choice(np.array(["p", "d", None], object), 3000, p=[0.6, 0.3, 0.1])
    ids = np.arange(3000) * 3
    bad = [(9001, None, "p"), (9002, [1.0] * (DIM - 1), "p"), (9003, [0.0] * DIM, "p"), (9004, [float("nan")] * DIM, "p"), (9005, [None] + [1.0] * (DIM - 1), None), (9006, [1e300] * DIM, "p"), (None, [1.0] * DIM, "p")]
    docs = spark.createDataFrame([(int(i), v.tolist(), t) for i, v, t in zip(ids, x, tags)] + bad, "id long, vec array<double>, tag string").selectExpr("id", "vec", "tag", "1 as cell", "2 as k")
    q = np.concatenate([points(80, 40, rng), x[:100:5] + 0.01, x[99:100]])
    ks = rng.integers(1, 15, len(q))
    wants = [None if i % 3 else "d" for i in range(len(q) - 1)] + [None]
    queries = [(i, v.tolist(), int(k), w) for i, (v, k, w) in enumerate(zip(q, ks, wants))]
    queries += [queries[0], (901, None, 3, None), (902, [0.0] * DIM, 3, None), (903, q[0].tolist(), 0, None), (904, q[0].tolist(), 3, "missing"), (905, q[0].tolist(), None, None), (None, q[0].tolist(), 3, None)]
    qs = spark.createDataFrame(queries, "qid long, vec array<float>, k int, tag string")
    rows = nearest_vectors(docs, "id", "vec", qs, "qid", "vec", "k", dim=DIM, tag="tag", wanted="tag", search=search).collect()
    got = {}
    for r in rows:
        got.setdefault(r["qid"], []).append((r["_distance"], r["id"]))
    assert set(got) == set(range(len(q)))
    hit = total = 0
    for i in range(len(q)):
        want = brute(x, ids, tags, q[i], ks[i], wants[i])
        mine = [j for _, j in sorted(got[i])]
        assert len(mine) == len(want) == len(set(mine))
        hit, total = hit + len(set(mine) & set(want)), total + len(want)
        for d, j in got[i]:
            assert d == pytest.approx(((x[j // 3].astype(np.float64) - q[i]) ** 2).sum(), rel=1e-5, abs=1e-6)
    assert hit / total >= 0.97
    assert [j for _, j in sorted(got[len(q) - 1])] == brute(x, ids, tags, q[-1], ks[-1], None)


def test_more_lists_than_probes(spark):
    rng = np.random.default_rng(6)
    x, ids = rng.normal(size=(3000, DIM)).astype(np.float32), np.arange(3000) // 2 * 2  # a cloud without groups; each id twice
    q = rng.normal(size=(40, DIM)).astype(np.float32)
    docs = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "id long, vec array<float>")
    qs = spark.createDataFrame([(i, v.tolist(), 10) for i, v in enumerate(q)], "qid long, vec array<float>, k int")
    got = {}
    for r in nearest_vectors(docs, "id", "vec", qs, "qid", "vec", "k", dim=DIM, search=Search(probes=24)).collect():
        got.setdefault(r["qid"], []).append((r["_distance"], r["id"]))
    hit = sum(sorted(i for _, i in got[j]) == sorted(brute(x, ids, None, v, 10, None)) for j, v in enumerate(q))
    assert hit >= 39


def shuffled_rows(spark, known=None):
    """Rows that the stages wrote for a shuffle, by stage; of those not yet known their sum."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    rows = {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in map(stages.apply, range(stages.size()))}
    return rows if known is None else sum(n for k, n in rows.items() if k not in known)


def test_queries_are_not_shuffled_to_cells(spark):
    rng = np.random.default_rng(41)
    x, q = rng.normal(size=(3000, DIM)).astype(np.float32), rng.normal(size=(400, DIM)).astype(np.float32)
    docs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<float>")
    qs = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(q)], "qid long, vec array<float>, k int")
    before = shuffled_rows(spark)
    got = {}
    # A cloud without groups: every query may have a neighbour in each of some 50 cells.
    for r in nearest_vectors(docs, "id", "vec", qs, "qid", "vec", "k", dim=DIM, search=Search(cell_rows=64, probes=24)).collect():
        got.setdefault(r["qid"], []).append((r["_distance"], r["id"]))
    assert sum(sorted(i for _, i in got[j]) == sorted(brute(x, np.arange(3000), None, v, 1, None)) for j, v in enumerate(q)) >= 395
    assert 3000 < shuffled_rows(spark, before) < 25_000


def test_many_pivots_meet_all_similar_vectors():
    rng = np.random.default_rng(9)
    pivots = rng.normal(size=(5000, 64)).astype(np.float32) * 4  # more than Router.ALL
    x = (pivots[:1500] + rng.normal(size=(1500, 64)) * 1.9).astype(np.float32)
    near = ((x.astype(np.float64) ** 2).sum(1)[:, None] + (pivots.astype(np.float64) ** 2).sum(1)[None] - 2 * x.astype(np.float64) @ pivots.T) < 350
    router = _router(pivots, 11)
    leaf, d = router.nearest(x, 2, within=350.0)
    assert near.any(1).sum() > 1400
    assert np.array_equal(d[:, 0] < 350, near.any(1)) and np.array_equal(d[:, 1] < 350, near.sum(1) > 1)
    assert near[np.arange(len(x)), router.order[leaf[:, 0]]][near.any(1)].all()


def test_minima_by_tasks_equal_those_in_order(spark):
    rng = np.random.default_rng(14)
    x = np.concatenate([points(900, 60, rng, 2.0), rng.normal(size=(900, DIM)) * 30]).astype(np.float32)[rng.permutation(1800)]
    assert np.array_equal(first_minima(spark, x, 60.0, 100), local_minima(x, 60.0)) and len(first_minima(spark, x[:0], 60.0, 100)) == 0


def test_near_clusters_of_many_regions(spark):
    rng = np.random.default_rng(10)
    x, radius = rng.normal(size=(6000, DIM)).astype(np.float32) * 3, rng.uniform(0, 3, 6000)
    rows = [(i, v.tobytes(), float(r), i % 5 == 0) for i, (v, r) in enumerate(zip(x, radius))]
    df = spark.createDataFrame(rows, "pivot long, centre binary, radius double, candidate boolean")
    got = {(r["a"], r["b"]) for r in _near_clusters(df, DIM, Clustering(threshold=36.0)).collect()}
    want = set()
    for a in range(0, 6000, 5):
        d = np.sqrt(((x.astype(np.float64) - x[a]) ** 2).sum(1))
        want |= {(min(a, b), max(a, b)) for b in np.flatnonzero(d < radius + radius[a] + 6).tolist() if b != a}
    assert len(want) > 1000 and want <= got and len(got) <= len(want) + 10


def test_large_elements(spark):
    rng = np.random.default_rng(12)
    centres = rng.normal(size=(40, DIM)) * 3000 + 20000
    x = np.concatenate([np.repeat(centres, 6, 0) + rng.normal(size=(240, DIM)) * 1.4, np.full((1, DIM), 1e20), np.full((1, DIM), 2e20)]).astype(np.float32)
    ids = np.arange(len(x))
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "doc long, vec array<float>")
    assert not (judged(x[:1], x[:1], 81.0) >= 81).any() and not (judged(x[-1:], x[-1:], 81.0) >= 81).any()
    clusters, membership = similarity_clusters(df, "doc", "vec", dim=DIM, clustering=Clustering(threshold=81.0))
    kept = {r["cluster"] for r in clusters.collect() if r["size"] >= 5 and r["mutual"] and r["isolated"]}
    assert {(m["cluster"], m["doc"]) for m in membership.collect() if m["cluster"] in kept} == brute_clusters(x.astype(np.float64), ids, 81, 5)
    qs = df.withColumnRenamed("doc", "qid").selectExpr("qid", "vec", "3 as k")
    got = {}
    for r in nearest_vectors(df, "doc", "vec", qs, "qid", "vec", "k", dim=DIM).collect():
        got.setdefault(r["qid"], []).append((r["_distance"], r["doc"]))
    assert all([j for _, j in sorted(got[i])] == brute(x, ids, None, v.astype(np.float64), 3, None) for i, v in enumerate(x))


def test_routing_sees_all_leaves():
    rng = np.random.default_rng(13)
    leaves = rng.normal(size=(6400, DIM)).astype(np.float32)  # more than Router.ALL, under 80 roots
    r = Router(leaves, rng.integers(80, size=6400), rng.normal(size=(80, DIM)).astype(np.float32))
    one = np.ones(6400)
    table = (np.arange(6400), np.full(6400, -1), one.astype(np.int64), one * 0, one * 0, one * 0)
    q = rng.normal(size=(50, DIM)).astype(np.float32)
    rows, lists, _, _ = route(q, np.full(50, 5), np.full(50, -1), r, table, 1, Search())
    for i, v in enumerate(q):
        near = np.argsort(((r.leaves.astype(np.float64) - v) ** 2).sum(1))[:5]
        assert set(near) <= set(lists[rows == i])


@pytest.mark.parametrize("how", [{}, {"most_tags": 4}, {"most_tags": 4, "probes": 4, "cell_rows": 64}, {"task_queries": 20, "plan_queries": 100, "cell_rows": 64}])
def test_many_tags_and_popular_queries(spark, how):
    rng = np.random.default_rng(21)
    x = points(2000, 20, rng)
    tags = np.array([f"t{int(t)}" for t in np.minimum(rng.geometric(0.08, 2000), 60)], object)
    tags[::9] = None
    df = spark.createDataFrame([(i, v.tolist(), t) for i, (v, t) in enumerate(zip(x, tags))], "id long, vec array<float>, tag string")
    q = np.concatenate([np.repeat(x[5:6] + 0.01, 120, 0), points(60, 20, rng)])
    wants = [None if i % 4 == 0 else f"t{1 + i % 70}" for i in range(len(q))]
    qs = spark.createDataFrame([(i, v.tolist(), 7, w) for i, (v, w) in enumerate(zip(q, wants))], "qid long, vec array<float>, k int, tag string")
    got = {i: [] for i in range(len(q))}
    for r in nearest_vectors(df, "id", "vec", qs, "qid", "vec", "k", dim=DIM, tag="tag", wanted="tag", search=Search(**how)).collect():
        got[r["qid"]].append((r["_distance"], r["id"]))
    want = [brute(x, np.arange(2000), tags, q[i], 7, wants[i]) for i in range(len(q))]
    assert all(len(got[i]) == len(w) for i, w in enumerate(want))
    hit = sum(len({j for _, j in got[i]} & set(w)) for i, w in enumerate(want))
    assert hit >= 0.97 * sum(map(len, want))


def test_copies_are_measured_once(spark):
    rng = np.random.default_rng(31)
    x = np.concatenate([np.repeat(points(3, 3, rng), [400, 150, 1], 0), points(200, 3, rng)])
    order = rng.permutation(len(x))
    x, ids, tags = x[order], rng.permutation(len(x)) * 7, np.array(["a", "b", None], object)[rng.integers(3, size=len(x))]
    df = spark.createDataFrame([(int(i), v.tolist(), t) for i, v, t in zip(ids, x, tags)], "id long, vec array<float>, tag string")
    q = np.concatenate([x[:60], x[:60] + 0.3]).astype(np.float32)
    ks, wants = rng.integers(1, 200, len(q)), [None if i % 2 else "ab"[i % 3 % 2] for i in range(len(q))]
    qs = spark.createDataFrame([(i, v.tolist(), int(k), w) for i, (v, k, w) in enumerate(zip(q, ks, wants))], "qid long, vec array<float>, k int, tag string")
    got = {i: [] for i in range(len(q))}
    for r in nearest_vectors(df, "id", "vec", qs, "qid", "vec", "k", dim=DIM, tag="tag", wanted="tag", search=Search(cell_rows=100)).collect():
        got[r["qid"]].append((r["_distance"], r["id"]))
    same = sum([j for _, j in sorted(got[i])] == brute(x, ids, tags, q[i].astype(np.float64), ks[i], wants[i]) for i in range(len(q)))
    assert same >= 0.97 * len(q)
    assert all(len(got[i]) == min(ks[i], len(x) if wants[i] is None else (tags == wants[i]).sum()) for i in range(len(q)))


def test_usable_vectors_are_rare(spark):
    few = spark.createDataFrame([(7, [1.0] * DIM), (400_007, [2.0] * DIM), (900_001, [3.0] * DIM)], "id long, vec array<float>")
    df = spark.range(600_000).selectExpr("id + 10 AS id", "CAST(NULL AS array<float>) AS vec").unionAll(few)
    qs = spark.createDataFrame([(1, [1.9] * DIM, 5)], "qid long, vec array<float>, k int")
    rows = nearest_vectors(df, "id", "vec", qs, "qid", "vec", "k", dim=DIM).collect()
    assert [r["id"] for r in sorted(rows, key=lambda r: r["_distance"])] == [400_007, 7, 900_001]


def test_empty_and_tiny_tables(spark):
    docs = spark.createDataFrame([(1, [1.0] * DIM), (2, [1.0] * DIM)], "id long, vec array<float>")
    qs = spark.createDataFrame([(1, [1.0] * DIM, 5)], "id long, vec array<float>, k int")
    ask = lambda d, q: sorted((r["qid"], r["id"]) for r in nearest_vectors(d, "id", "vec", q.withColumnRenamed("id", "qid"), "qid", "vec", "k", dim=DIM).collect())
    assert ask(docs, qs) == [(1, 1), (1, 2)]
    assert ask(docs.limit(0), qs) == [] and ask(docs, qs.limit(0)) == []


def brute_clusters(x, ids, threshold, least):
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    near = d < threshold
    out = set()
    for i in range(len(x)):
        group = np.flatnonzero(near[i])
        if len(group) >= least and ids[group].min() == ids[i] and all(np.array_equal(np.flatnonzero(near[j]), group) for j in group):
            out |= {(int(ids[i]), int(ids[j])) for j in group}
    return out


@pytest.mark.parametrize("chunk", [2048, 7])
def test_clusters(spark, chunk):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(60, DIM)) * 12
    parts = [c + rng.normal(size=(n, DIM)) * 0.8 for c, n in zip(centres, [300, 90, 40, *rng.integers(1, 16, 57)])]
    # Two groups that touch by one pair, a chain, and a cloud that is too wide to be mutual.
    a = centres[0] + 60
    bridge = [a + rng.normal(size=(8, DIM)) * 0.3, a + np.eye(DIM)[0] * 10.8 + rng.normal(size=(8, DIM)) * 0.3, (a + np.eye(DIM)[0] * 5.4)[None]]
    wide = centres[1] - 80 + rng.normal(size=(30, DIM)) * 1.9
    x = np.concatenate([*parts, *bridge, wide, parts[3][:1].repeat(9, 0)]).astype(np.float32)
    order = rng.permutation(len(x))
    x, ids = x[order], np.arange(len(x)) * 2 + 100
    c = Clustering(threshold=81.0, chunk=chunk, stretch=1.0)
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)] + [(1, None), (2, [0.0] * DIM), (3, [1.0]), (None, x[0].tolist())], "doc long, vec array<float>").selectExpr("doc", "vec", "doc as pivot", "1 as n")
    clusters, membership = similarity_clusters(df, "doc", "vec", dim=DIM, clustering=c)
    rows = {r["cluster"]: r for r in clusters.collect()}
    members = membership.collect()
    assert sorted(m["doc"] for m in members) == sorted(ids.tolist())
    by = {}
    for m in members:
        by.setdefault(m["cluster"], []).append(m["doc"])
    assert {k: len(v) for k, v in by.items()} == {k: r["size"] for k, r in rows.items()}
    at = {int(i): v for i, v in zip(ids, x.astype(np.float64))}
    for k, docs in by.items():
        assert k == min(docs)
        m = np.array([at[d] for d in docs])
        mutual = (((m[:, None] - m[None]) ** 2).sum(2) < 81).all()
        assert mutual == rows[k]["mutual"], k
        far = {d: np.linalg.norm(at[d] - m.mean(0)) for d in docs}
        assert set(rows[k]["typical"]) <= set(docs) and far[rows[k]["typical"][0]] == pytest.approx(min(far.values()), abs=1e-4)
    got = {(m["cluster"], m["doc"]) for m in members if rows[m["cluster"]]["size"] >= 5 and rows[m["cluster"]]["mutual"] and rows[m["cluster"]]["isolated"]}
    assert got == brute_clusters(x.astype(np.float64), ids, 81, 5)
    assert len({k for k, _ in got}) > 20


def test_other_id_types(spark):
    df = spark.createDataFrame([(1, [1.0] * DIM), (2, [1.0] * DIM)], "id int, vec array<float>")
    clusters, membership = similarity_clusters(df, "id", "vec", dim=DIM)
    assert clusters.first()["size"] == 2 and membership.count() == 2
    with pytest.raises(ValueError, match="integers"):
        similarity_clusters(df.selectExpr("cast(id as string) as id", "vec"), "id", "vec", dim=DIM)


def test_no_vectors(spark):
    df = spark.createDataFrame([(1, None)], "doc long, vec array<float>")
    clusters, membership = similarity_clusters(df, "doc", "vec", dim=DIM)
    assert clusters.count() == 0 and membership.count() == 0
