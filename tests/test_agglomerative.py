"""RAC agglomeration equals naive greedy agglomeration on complete graphs."""

import itertools

import numpy as np
import pytest

from flowlens.operators import agglomerative


def _naive(X, k, linkage):
    clusters = [[i] for i in range(len(X))]

    def dist(A, B):
        if linkage == "ward":
            ca, cb = X[A].mean(0), X[B].mean(0)
            return np.sqrt(2.0 * len(A) * len(B) / (len(A) + len(B))) * np.linalg.norm(ca - cb)
        d = np.sqrt(((X[A][:, None, :] - X[B][None, :, :]) ** 2).sum(2))
        return d.max() if linkage == "complete" else d.mean()

    while len(clusters) > k:
        best = min(itertools.combinations(range(len(clusters)), 2),
                   key=lambda p: dist(clusters[p[0]], clusters[p[1]]))
        a, b = best
        clusters[a] = clusters[a] + clusters[b]
        del clusters[b]
    return {frozenset(c) for c in clusters}


@pytest.mark.parametrize("linkage", ["ward", "average", "complete"])
def test_rac_matches_naive_on_complete_graph(spark, linkage):
    rng = np.random.default_rng(3)
    centers = rng.normal(scale=6, size=(4, 3))
    X = np.vstack([c + rng.normal(size=(10, 3)) for c in centers])
    pts = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(X)], "id long, vec array<double>")
    edges = spark.createDataFrame([(i, j) for i in range(len(X)) for j in range(i + 1, len(X))], "i long, j long")
    merges, _ = agglomerative.dendrogram(pts, "vec", "id", edges, linkage)
    for k in (2, 4, 7):
        lab = agglomerative.cut(pts, "id", merges, k).collect()
        got = {}
        for r in lab:
            got.setdefault(r.cluster, set()).add(r.id)
        assert {frozenset(v) for v in got.values()} == _naive(X, k, linkage)
        assert all(min(v) == c for c, v in got.items())


def test_chain_of_doubling_gaps_merges_to_one(spark):
    import itertools
    n = 8
    pts = spark.createDataFrame([(k, [float(2 ** k)]) for k in range(n)], "id long, v array<double>")
    edges = spark.createDataFrame(list(itertools.combinations(range(n), 2)), "i long, j long")
    merges, _ = agglomerative.dendrogram(pts, "v", "id", edges, "complete")
    assert merges.count() == n - 1
    assert agglomerative.cut(pts, "id", merges, 2).select("cluster").distinct().count() == 2


def test_neighbours_are_added_until_one_component(spark):
    from flowlens.operators import components
    rng = np.random.default_rng(2)
    sizes = (12, 15, 40)
    X = np.vstack([rng.normal(size=(m, 2)) + 100 * c for c, m in enumerate(sizes)])
    pts = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(X)], "id long, vec array<double>")
    order = np.argsort(((X[:, None] - X[None]) ** 2).sum(2) + np.diag([np.inf] * len(X)), axis=1, kind="stable")

    def parts(k):
        label = np.arange(len(X))
        for _ in X:
            for i, js in enumerate(order[:, :k]):
                label[[i, *js]] = label[[i, *js]].min()
        return len(set(label.tolist()))

    want = [(k, parts(k)) for k in (3, 11, 12, 13, 15, 20)]
    assert want[1] == (11, 3)
    stop = next(at for at, (_, n) in enumerate(want) if n == 1) + 1
    rows, graph = components.connect_until_one(pts, "vec", "id", (3, 11, 12, 13, 15, 20))
    assert rows == want[:stop] and stop < len(want)
    assert graph.count() == rows[-1][0] * len(X)
    rows, graph = components.connect_until_one(pts, "vec", "id", (3, 11))
    assert rows == want[:2] and graph.count() == 11 * len(X)
    assert components.CONNECT_KS == tuple(range(30, 401, 20))


def test_a_graph_of_more_components_than_clusters_is_no_cut(spark):
    pts = spark.createDataFrame([(k, [float(k)]) for k in range(6)], "id long, v array<double>")
    edges = spark.createDataFrame([(0, 1), (2, 3), (4, 5)], "i long, j long")
    merges, _ = agglomerative.dendrogram(pts, "v", "id", edges, "ward")
    assert agglomerative.cut(pts, "id", merges, 3).select("cluster").distinct().count() == 3
    with pytest.raises(ValueError, match="3 components"):
        agglomerative.cut(pts, "id", merges, 2)


def test_contracted_graphs_go_on_in_one_task_alike(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(80, 3)) + rng.integers(0, 3, (80, 1)) * 4
    pts = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, vec array<double>")
    near = np.argsort(((x[:, None] - x[None]) ** 2).sum(axis=2), axis=1)[:, 1:7]
    edges = spark.createDataFrame([(i, int(j)) for i in range(80) for j in near[i]], "i long, j long")
    # whole graphs by Spark's rounds, from the middle on in a task, and in a task from the start
    got = []
    for limit in (0, 9_000, None):
        rows = agglomerative.dendrograms(pts, "vec", "id", edges, finished=limit).collect()
        got.append(sorted((r.linkage, r["round"], r.a, r.b, round(r.h, 9), round(r.hmono, 9), r.n) for r in rows))
    assert got[0] == got[1] == got[2]
    assert {r[0] for r in got[0]} == set(agglomerative.LINKAGES) and max(r[1] for r in got[0]) > 4


def test_rows_of_the_same_key_are_one_point(spark):
    rows = [(i, [float(i * i)]) for i in range(12)]
    once = spark.createDataFrame(rows, "id long, vec array<double>")
    twice = spark.createDataFrame(rows + rows[:7], "id long, vec array<double>")
    edges = spark.createDataFrame([(i, i + 1) for i in range(11)], "i long, j long")
    for limit in (0, None):
        got = [sorted(map(tuple, agglomerative.agglomerative(p, "vec", "id", edges, "ward", 2, finished=limit).collect())) for p in (once, twice)]
        assert got[0] == got[1] and len(got[0]) == 12


def test_no_more_neighbours_than_the_graph_needs(spark, monkeypatch):
    from flowlens.operators import components
    rng = np.random.default_rng(21)
    x = np.concatenate([rng.normal(0, 1, (45, 2)), rng.normal(60, 1, (45, 2))])
    pts = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, vec array<double>")
    asked, knn = [], components.knn
    monkeypatch.setattr(components, "knn", lambda p, c, key, k, **kw: (asked.append(k), knn(p, c, key, k, **kw))[1])
    rows, graph = components.connect_until_one(pts, "vec", "id")
    assert rows == [(30, 2), (50, 1)] and graph.count() == 50 * 90
    assert asked == [30, 110]


def test_known_distances_give_the_same_merges_and_move_no_vectors(spark):
    rng = np.random.default_rng(22)
    x = rng.normal(size=(60, 3)) + rng.integers(0, 3, (60, 1)) * 4
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    near = np.argsort(d, axis=1)[:, 1:7]
    pts = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, vec array<double>")
    edges = spark.createDataFrame([(i, int(j), float(d[i, j])) for i in range(60) for j in near[i]], "i long, j long, dist double")
    got = []
    for limit in (0, None):
        for dist in ("dist", None):
            rows = agglomerative.dendrograms(pts, "vec", "id", edges, finished=limit, dist=dist).collect()
            got.append(sorted((r.linkage, r["round"], r.a, r.b, round(r.h, 9), round(r.hmono, 9), r.n) for r in rows))
    assert all(g == got[0] for g in got) and {r[0] for r in got[0]} == set(agglomerative.LINKAGES)
    # a vector may not be read where the distance is known: complete linkage has no centres
    blind = spark.createDataFrame([(i, [0.0]) for i in range(60)], "id long, vec array<double>")
    rows = agglomerative.dendrograms(blind, "vec", "id", edges, ("complete",), finished=0, dist="dist").collect()
    assert sorted(("complete", r["round"], r.a, r.b, round(r.h, 9), round(r.hmono, 9), r.n) for r in rows) == [r for r in got[0] if r[0] == "complete"]


def test_cuts_at_several_k_are_the_cuts_at_each(spark):
    rng = np.random.default_rng(23)
    x = rng.normal(size=(40, 2))
    pts = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, vec array<double>")
    edges = spark.createDataFrame([(i, j) for i in range(40) for j in range(i + 1, 40)], "i long, j long")
    merges = agglomerative.dendrograms(pts, "vec", "id", edges, ("ward", "average")).cache()
    configs = [("ward", 3), ("average", 12), ("ward", 40), ("ward", 7), ("average", 1), ("average", 50)]
    got = {}
    for r in agglomerative.cuts(pts, "id", merges, configs).collect():
        got.setdefault(r.config, {})[r.id] = r.cluster
    for c, (linkage, k) in enumerate(configs):
        own = sorted((r.hmono, r["round"], r.a, r.b) for r in merges.where(f"linkage = '{linkage}'").collect())
        label = list(range(40))
        for *_, a, b in own[:max(0, 40 - k)]:
            low, high = sorted((label[a], label[b]))
            label = [low if v == high else v for v in label]
        assert got[c] == dict(enumerate(label)) and len(set(label)) == min(k, 40)


def test_lists_of_several_cells_merge_by_distance_and_key(spark):
    from flowlens.operators import neighbors
    lists = spark.createDataFrame([(1, [5, 9], [0.5, 2.0]), (1, [2, 3, 4], [0.5, 1.0, 2.0]), (2, [8], [0.0])],
                                  "i long, j array<long>, d2 array<double>")
    rows = neighbors._merge(lists, 4, 2, rows=True).orderBy("i", "rank").collect()
    assert [tuple(r) for r in rows] == [(1, 2, 0.5, 1), (1, 5, 0.5, 2), (1, 3, 1.0, 3), (1, 4, 2.0, 4), (2, 8, 0.0, 1)]


def test_small_ks_share_a_search_unless_keys_repeat(spark, monkeypatch):
    from flowlens.operators import components
    rng = np.random.default_rng(24)
    x = [[float(v) for v in r] for r in np.concatenate([rng.normal(0, 1, (45, 2)), rng.normal(60, 1, (45, 2))])]
    asked, knn = [], components.knn
    monkeypatch.setattr(components, "knn", lambda p, c, key, k, **kw: (asked.append(k), knn(p, c, key, k, **kw))[1])
    pts = spark.createDataFrame(list(enumerate(x)), "id long, vec array<double>")
    rows, _ = components.connect_until_one(pts, "vec", "id", (1, 2, 8, 30, 50))
    assert [k for k, _ in rows] == [1, 2, 8, 30, 50] and rows[-1][1] == 1 and asked == [30, 50]
    alone = [components.connect_until_one(pts, "vec", "id", (k,))[0][0] for k in (1, 2, 8)]
    assert rows[:3] == alone
    del asked[:]
    twice = pts.unionByName(pts.where("id < 3"))
    assert components.connect_until_one(twice, "vec", "id", (1, 2))[0][0] == components.connect_until_one(twice, "vec", "id", (1,))[0][0]
    assert asked[0] == 1
