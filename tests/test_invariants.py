"""Invariants for operators without an SQL twin, and edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_MID, SF_SMALL
from flowlens.operators import cleaning, components, dbscan, kmeans, neighbors, reduce, splits
from flowlens.sources.fixtures import flows, points2d, vectors
from flowlens.sources.io import read_table, require_columns


def test_format_dispatch_and_contract(spark):
    with pytest.raises(ValueError):
        read_table(spark, "/x/y.json")
    df = spark.createDataFrame([(1,)], "a int")
    with pytest.raises(ValueError):
        require_columns(df)


def test_exact_median_and_mode(spark):
    rng = np.random.default_rng(0)
    for n in (1, 2, 5, 1000):
        x = rng.normal(size=n).round(3)
        df = spark.createDataFrame([(float(v),) for v in x], "v double")
        assert cleaning.exact_median(df, "v", accuracy=50) == pytest.approx(float(np.median(x)))
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,)], "v double")
    assert cleaning.exact_median(df, "v") == 2.5
    m = cleaning.ModeImputer(["s"]).fit(spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,)], "s string"))
    assert m.values["s"] == "a"


def test_three_way_split_is_group_disjoint(spark):
    df = flows(spark, SF_SMALL)
    out = splits.three_way_split(df)
    assert out.count() == df.count()
    per_group = out.groupBy("grp").agg(F.countDistinct("split").alias("k"))
    assert per_group.where("k > 1").count() == 0
    assert {r["split"] for r in out.select("split").distinct().collect()} == {"train", "valid", "test"}


def test_deal_is_the_same_for_any_number_of_partitions(spark):
    df = flows(spark, SF_SMALL)
    groups = splits.group_table(splits.group_folds(df), "type")
    want = None
    for n in (1, 3, 8):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        got = sorted(map(tuple, splits.deal_folds(groups, 5, 42).collect()))
        want = want or got
        assert got == want
    assert len({f for _, f in want}) == 5


def test_unmapped_clusters_are_unknown(spark):
    from flowlens.operators import profile
    df = spark.createDataFrame([(1, 0, "a"), (2, 1, "b")], "flow_id long, cluster int, type string")
    m = profile.dominant_map(df.where("cluster = 0"), "cluster", "type")
    got = profile.classify_by_map(df, m, "cluster", out="y").select("flow_id", "y").collect()
    assert sorted(map(tuple, got)) == [(1, "a"), (2, "unknown")]


def _brute_knn(X, ids, k, include_self):
    D = ((X[:, None, :] - X[None, :, :]) ** 2).sum(2)
    out = {}
    for a in range(len(ids)):
        cand = [b for b in range(len(ids)) if include_self or b != a]
        out[ids[a]] = [ids[b] for b in sorted(cand, key=lambda b: (D[a, b], ids[b]))[:k]]
    return out


def test_knn_exact_with_many_pivots_and_small_blocks(spark):
    v = vectors(spark, SF_SMALL)
    rows = v.collect()
    X, ids = np.array([r.vec for r in rows]), [r.id for r in rows]
    for include_self in (True, False):
        got = {}
        for r in neighbors.knn(v, "vec", "id", 4, include_self=include_self, n_pivots=6, block=40).collect():
            got.setdefault(r.i, []).append((r.rank, r.j))
        exp = _brute_knn(X, ids, 4, include_self)
        assert {i: [j for _, j in sorted(v_)] for i, v_ in got.items()} == exp


def test_eps_pairs_exact(spark):
    p = points2d(spark, SF_MID).select("id", F.array("x", "y").alias("v"))
    rows = p.collect()
    P, ids = np.array([r.v for r in rows]), np.array([r.id for r in rows])
    D2 = ((P[:, None, :] - P[None, :, :]) ** 2).sum(2)
    exp = {(ids[a], ids[b]) for a, b in zip(*np.nonzero(D2 <= 0.5 ** 2))}
    got = {(r.i, r.j) for r in neighbors.eps_pairs(p, "v", "id", 0.5, n_pivots=12, block=64).collect()}
    assert got == exp


def test_connected_components_match_union_find(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (10, 11), (5, 5), (7, 3), (20, 21), (21, 22), (22, 20)],
                                  "src long, dst long")
    verts = spark.createDataFrame([(i,) for i in (1, 2, 3, 5, 7, 10, 11, 20, 21, 22, 99)], "id long")
    lab = {r.id: r.component for r in components.connected_components(edges, verts).collect()}
    assert lab == {1: 1, 2: 1, 3: 1, 7: 1, 5: 5, 10: 10, 11: 10, 20: 20, 21: 20, 22: 20, 99: 99}


def test_dbscan_noise_non_increasing_in_eps(spark):
    p = points2d(spark, SF_SMALL).select("id", F.array("x", "y").alias("v"))
    grid = [(e, 3) for e in (0.2, 0.4, 0.8, 1.6)]
    lab = dbscan.dbscan_grid(p, "v", "id", grid)
    noise = {r["eps"]: r["nr"] for r in lab.groupBy("eps").agg(
        F.avg(F.when(F.col("cluster") == -1, 1.0).otherwise(0.0)).alias("nr")).collect()}
    vals = [noise[e] for e, _ in grid]
    assert all(a >= b for a, b in zip(vals, vals[1:]))


def test_svd_orthonormal_and_energy(spark):
    rng = np.random.default_rng(1)
    X = rng.normal(size=(300, 8)) @ rng.normal(size=(8, 8))
    df = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(X)], "id long, x array<double>")
    svd = reduce.TruncatedSVD(k=5).fit(df, 8)
    V = svd.components
    assert np.allclose(V.T @ V, np.eye(5), atol=1e-10)
    assert np.all(np.diff(svd.singular_values) <= 1e-9)
    ref = np.linalg.svd(X, compute_uv=False)[:5]
    assert np.allclose(svd.singular_values, ref, rtol=1e-8)
    Z = np.array([r.emb for r in svd.transform(df).orderBy("id").collect()])
    assert np.allclose((Z ** 2).sum(), (ref ** 2).sum(), rtol=1e-8)


def test_lloyd_inertia_non_increasing(spark):
    v = vectors(spark, SF_SMALL)
    init = np.array([r.vec for r in cleaning.exact_sample(v, 4, key="id").collect()])
    costs = []
    for steps in (0, 1, 2, 3):
        c = kmeans.lloyd(v, "vec", init, steps)
        costs.append(kmeans.inertia(kmeans.assign(v, "vec", c, "cl", "d2")))
    assert all(a >= b - 1e-9 for a, b in zip(costs, costs[1:]))


def test_embedder_shapes(spark):
    df = flows(spark, SF_SMALL)
    emb = reduce.FlowEmbedder(k=6).fit(df.where("split = 'train'"))
    z = emb.transform(df)
    assert z.count() == df.count()
    Z = np.array([r.emb for r in z.collect()])
    assert Z.shape[1] == 6
    tr = np.array([r.emb for r in emb.transform(df.where("split = 'train'")).collect()])
    assert np.allclose(tr.mean(0), 0, atol=1e-8)


def test_csv_sink_round_trip_and_typed_columns(spark, tmp_path):
    from flowlens.functions.columns import split_columns
    from flowlens.sources.io import write_csv
    from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType
    df = spark.createDataFrame([(1, "a", 0.5), (2, None, 1.5)], "id long, s string, x double")
    write_csv(df, str(tmp_path / "t.csv"))
    schema = StructType([StructField("id", LongType()), StructField("s", StringType()),
                         StructField("x", DoubleType())])
    back = read_table(spark, str(tmp_path / "t.csv"), schema)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    num, cat = split_columns(flows(spark, SF_SMALL), exclude=("flow_id",))
    assert "duration" in num and "src_bytes" in num and "ts" not in num + cat
    assert {"src_ip", "dst_ip", "proto", "service", "type"} <= set(cat)


def test_internal_scores_degenerate_guard(spark):
    from flowlens.operators import internal
    one = spark.createDataFrame([(i, [float(i), 0.0], 0) for i in range(5)], "id long, v array<double>, c int")
    assert internal.silhouette(one, "v", "c", "id", 5) is None
    assert internal.davies_bouldin(one, "v", "c", 2) is None
    assert internal.calinski_harabasz(one, "v", "c", 2) is None


def test_dbscan_duplicates_equal_weighted(spark):
    """A hot duplicate group gives the same labels as the plain definition."""
    rng = np.random.default_rng(5)
    pts = [(i, [float(x) for x in rng.normal(size=2)]) for i in range(60)]
    pts += [(100 + i, [3.0, 3.0]) for i in range(40)]  # one hot vector, 40 copies
    pts += [(200, [3.2, 3.0]), (201, [9.0, 9.0])]
    df = spark.createDataFrame(pts, "id long, v array<double>")
    got = {r.id: r.cluster for r in dbscan.dbscan(df, "v", "id", 0.5, 5).collect()}
    P = np.array([p for _, p in pts]); ids = [i for i, _ in pts]
    D = np.sqrt(((P[:, None] - P[None]) ** 2).sum(2)) <= 0.5
    core = D.sum(1) >= 5
    lab = {}
    for a in range(len(P)):
        if core[a] and ids[a] not in lab:
            stack, comp = [a], []
            seen = {a}
            while stack:
                x = stack.pop(); comp.append(x)
                for y in np.nonzero(D[x] & core)[0]:
                    if y not in seen:
                        seen.add(y); stack.append(y)
            cid = min(ids[x] for x in comp)
            for x in comp:
                lab[ids[x]] = cid
    for a in range(len(P)):
        if not core[a]:
            near = [lab[ids[y]] for y in np.nonzero(D[a] & core)[0]]
            lab[ids[a]] = min(near) if near else -1
    assert got == lab
    assert got[100] == 100 and got[200] == 100 and got[201] == -1


def test_knn_with_hot_duplicate_group_is_exact(spark):
    rng = np.random.default_rng(9)
    pts = [(i, [float(x) for x in rng.normal(size=3)]) for i in range(80)]
    pts += [(1000 + i, [0.1, 0.1, 0.1]) for i in range(30)]  # hot vector
    pts += [(2000 + i, [0.5, 0.5, 0.5]) for i in range(3)]   # small duplicate group
    df = spark.createDataFrame(pts, "id long, vec array<double>")
    X, ids = np.array([p for _, p in pts]), [i for i, _ in pts]
    for include_self in (True, False):
        got = {}
        for r in neighbors.knn(df, "vec", "id", 5, include_self=include_self, n_pivots=5, block=16).collect():
            got.setdefault(r.i, []).append((r.rank, r.j))
        exp = _brute_knn(X, ids, 5, include_self)
        assert {i: [j for _, j in sorted(v_)] for i, v_ in got.items()} == exp


def test_connectivity_lookup_paths_agree(spark, monkeypatch):
    from flowlens.operators import connectivity
    df = flows(spark, SF_SMALL)
    model = connectivity.ConnectivityFeaturizer().fit(df.where("split = 'train'"))
    cols = ["flow_id", "src_port_top", "dst_port_top"] + connectivity.COUNT_COLUMNS
    small = sorted(map(tuple, model.transform(df).select(*cols).collect()))
    monkeypatch.setattr(connectivity, "BROADCAST_PAIRS", -1)
    large = sorted(map(tuple, model.transform(df).select(*cols).collect()))
    assert small == large and len(small) == df.count()


def test_knn_breaks_ties_by_key_however_many(spark):
    n = 60
    df = spark.createDataFrame([(k, [float(j == k) for j in range(n)]) for k in range(n)], "id long, v array<double>")
    for pivots in (1, 7):
        got = {}
        for r in neighbors.knn(df, "v", "id", 3, include_self=False, n_pivots=pivots, block=16).collect():
            got.setdefault(r.i, {})[r["rank"]] = r.j
        want = {k: dict(enumerate([j for j in range(4) if j != k][:3], 1)) for k in range(n)}
        assert got == want


def test_eps_join_is_complete_on_a_lattice(spark):
    pts = [(30 * a + b, [0.1 * a, 0.1 * b]) for a in range(30) for b in range(30)]
    x = np.array([p for _, p in pts])
    d2 = ((x[:, None, :] - x[None, :, :]) ** 2).sum(2)
    df = spark.createDataFrame(pts, "id long, v array<double>")
    for pivots, eps in ((16, 0.5), (60, 0.1), (60, 0.2), (60, 0.30000000000000004)):
        got = neighbors.eps_pairs(df, "v", "id", eps, include_self=False, n_pivots=pivots)
        assert got.count() == int((d2 <= eps * eps).sum()) - len(pts)


def test_fitted_featuriser_keeps_its_parameters(spark, tmp_path):
    from flowlens.operators.connectivity import ConnectivityFeaturizer, ConnectivityModel
    df = flows(spark, SF_SMALL)
    model = ConnectivityFeaturizer(topN=3, logCounts=False, dropRawIps=False).fit(df)
    model.save_state(str(tmp_path))
    again = ConnectivityModel.load_state(spark, str(tmp_path))
    assert sorted(map(str, model.transform(df).collect())) == sorted(map(str, again.transform(df).collect()))


def test_hypergeometric_draws(spark):
    from flowlens.operators.external import hypergeometric
    rng = np.random.default_rng(1)
    draws = np.array([hypergeometric(7, 20, 9, rng) for _ in range(4000)])
    from math import comb
    for x in range(8):
        p = comb(7, x) * comb(13, 9 - x) / comb(20, 9) if 9 - x <= 13 else 0
        assert abs((draws == x).mean() - p) < 0.03
    big = np.array([hypergeometric(800_000_000, 2_000_000_000, 500_000_000, rng) for _ in range(50)])
    sd = (5e8 * 0.4 * 0.6 * (1.5e9 / 2e9)) ** 0.5
    assert abs(big.mean() - 2e8) < 4 * sd / 50 ** 0.5
    assert hypergeometric(0, 5, 3, rng) == 0 and hypergeometric(5, 5, 3, rng) == 3


def test_permutation_test_of_equal_and_unrelated_labels(spark):
    from flowlens.operators.external import permutation_test
    df = spark.range(600).selectExpr("id % 3 as a", "id % 3 as b", "hash(id) % 2 as c")
    same = permutation_test(df, "a", "b", replicates=19).collect()
    assert all(r.p_value == 1 / 20 for r in same)
    other = permutation_test(df, "a", "c", replicates=19).collect()
    assert all(1 / 20 <= r.p_value <= 1 for r in other)


def test_grouped_cv_fits_inside_the_fold(spark):
    from flowlens.operators import classify
    rows = [(k, float(k % 7), "only-in-fold-0" if k % 3 == 0 else f"s{k % 2}", f"t{k % 2}", k % 3) for k in range(90)]
    df = spark.createDataFrame(rows, "flow_id long, x double, service string, type string, fold int")
    design = classify.SupervisedDesign(["type"], ["flow_id"], 1, ["fold"], 3).fit(df)
    seen = [{r["v"] for r in design.lookup.collect() if r["states"][f]} for f in range(3)]
    assert "only-in-fold-0" not in seen[0] and all("only-in-fold-0" in s for s in seen[1:])
    (target, mean, _, scores), = classify.grouped_cv(df, ["type"], ["fold"], 3, ["flow_id"], 1, num_trees=3)
    assert target == "type" and len(scores) == 3 and 0 <= mean <= 1
    with pytest.raises(ValueError):
        classify.grouped_cv(df, ["type"], ["fold"], 4, ["flow_id"], num_trees=3)


def test_registered_sweeps_have_the_reference_sizes(monkeypatch):
    from types import SimpleNamespace as Some
    from flowlens.operators import classify
    from flowlens.plans import exploratory, model_queries, two_phase
    seen, made = {}, []
    frame = Some(where=lambda *_: frame, select=lambda *_: frame, join=lambda *_: frame)
    spark_ = Some(createDataFrame=lambda rows, _: made.extend(rows))
    monkeypatch.setattr(model_queries, "_embedded", lambda *_, **__: (None, None, frame))
    monkeypatch.setattr(model_queries, "flows", lambda *_: frame)
    monkeypatch.setattr(exploratory, "kmeans_sweep", lambda z, ks, **kw: seen.update(ks=list(ks), **kw))
    monkeypatch.setattr(exploratory, "dbscan_sweep", lambda z, **kw: seen.update(**kw))
    monkeypatch.setattr(two_phase, "unsupervised", lambda df, **kw: seen.update(two=kw) or (frame, None, None))
    monkeypatch.setattr(two_phase, "external_by_split", lambda art: art)
    monkeypatch.setattr(splits, "group_folds", lambda df, target, k, seed: frame)
    monkeypatch.setattr(classify, "grouped_cv", lambda df, targets, folds, k, exclude, **kw:
                        seen.update(cv=kw) or [(t, 1.0, 0.0, [1.0] * k) for t in targets])
    for name in ("kmeans_sweep", "dbscan_sweep", "two_phase_external", "grouped_cv"):
        getattr(model_queries, f"q_{name}")(spark_, "")
    assert seen["ks"] == list(range(2, 61)) and seen["n_init"] == seen["two"]["n_init"] == 10
    assert seen["min_samples"] == (10, 20, 30)
    assert made == [(t, 1.0, 0.0, 10) for t in ("cluster", "type", "label")]
    assert seen["cv"] == model_queries.FOREST == {"num_trees": 150, "seed": 10000}     # and no limit of depth


def test_median_and_eps_of_shared_values_bring_no_rows_together(spark, monkeypatch):
    """A value of most rows is one counted row; no sorted run, no exact percentile."""
    def refuse(*_, **__):
        raise AssertionError("rows of a column in one place")

    monkeypatch.setattr(type(spark.range(1)), "offset", refuse)
    monkeypatch.setattr(F, "percentile", refuse)
    rng = np.random.default_rng(6)
    cases = [[7.0] * 300 + list(range(150)), [1.0] * 50 + [2.0] * 50, [None, 3.0], [0.5] * 9, [1.0] * 51 + [9.0] * 50,
             rng.normal(size=501), rng.integers(0, 4, 400) / 3]
    for x in cases:
        df = spark.createDataFrame([(None if v is None else float(v),) for v in x], "v double").repartition(3)
        x = np.array([v for v in x if v is not None], float)
        for accuracy in (4, 50, 10000):
            assert cleaning.exact_median(df, "v", accuracy=accuracy) == pytest.approx(float(np.median(x)))
        got = sorted(r.eps for r in dbscan.eps_candidates(df.withColumnRenamed("v", "kdist"), digits=9).collect())
        assert got == pytest.approx(sorted(set(np.quantile(x, dbscan.EPS_QUANTILES).round(9).tolist())))
    empty = spark.createDataFrame([], "v double")
    assert cleaning.exact_median(empty, "v") is None
    assert dbscan.eps_candidates(empty.withColumnRenamed("v", "kdist")).count() == 0
