"""Split, encoding, reduction, k-means and internal-score queries (SPL, ENC, CLU-1..4, EVA-1..3)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from flowlens.functions.columns import round_d, well_known_flag
from flowlens.operators import internal, kmeans, reduce, splits
from flowlens.operators.cleaning import exact_sample
from flowlens.operators.encode import RareOneHot, Scaler
from flowlens.plans.registry import query
from flowlens.sources.fixtures import flows, vectors, with_views

# ---- SPL -------------------------------------------------------------------------

_GRP = ("concat_ws('|', coalesce(src_ip, 'NA'), coalesce(dst_ip, 'NA'), coalesce(service, 'NA'), "
        "coalesce(proto, 'NA'))")


def _deal_sql(src: str, seed: int, k: int = 5) -> str:
    return (f"select grp, cast(case when rn % {2 * k} < {k} then rn % {2 * k} else {2 * k - 1} - rn % {2 * k} "
            f"end as integer) as fold from (select grp, row_number() over (partition by dom order by size desc, "
            f"md5(concat(grp, '{seed}')) asc, grp asc) - 1 as rn from (select grp, sum(n) as size, "
            f"arg_min(type, (-n, type)) as dom from (select grp, type, count(*) as n from {src} group by all) "
            f"group by grp))")


@query("group_folds", with_views(
    "select g.flow_id, f.fold from g join f1 f using (grp)",
    ("g", f"select flow_id, type, {_GRP} as grp from flows"), ("f1", _deal_sql("g", 42))))
def q_group_folds(spark, sf_dir):
    return splits.group_folds(flows(spark, sf_dir), "type", 5, 42).select("flow_id", "fold")


@query("three_way_split", with_views(
    "select g.flow_id, case when f1.fold = 0 then 'test' when f2.fold = 0 then 'valid' else 'train' end as split "
    "from g join f1 using (grp) left join f2 using (grp)",
    ("g", f"select flow_id, type, {_GRP} as grp from flows"), ("f1", _deal_sql("g", 42)),
    ("rest", "select g.* from g join f1 using (grp) where f1.fold <> 0"), ("f2", _deal_sql("rest", 123))))
def q_three_way_split(spark, sf_dir):
    return splits.three_way_split(flows(spark, sf_dir)).select("flow_id", "split")


# ---- ENC -------------------------------------------------------------------------

@query("scale_no_mean", with_views(
    "select flow_id, round(ln(1 + duration) / coalesce(nullif(s.sd, 0), 1), 9) as duration, "
    "round(ln(1 + src_bytes) / coalesce(nullif(s.sb, 0), 1), 9) as src_bytes from flows, "
    "(select stddev_pop(ln(1 + duration)) as sd, stddev_pop(ln(1 + src_bytes)) as sb from flows) s"))
def q_scale_no_mean(spark, sf_dir):
    df = flows(spark, sf_dir).select("flow_id", F.log1p("duration").alias("duration"),
                                     F.log1p("src_bytes").alias("src_bytes"))
    out = Scaler(["duration", "src_bytes"]).fit(df).transform(df)
    return out.select("flow_id", round_d("duration").alias("duration"), round_d("src_bytes").alias("src_bytes"))


@query("standardize", with_views(
    "select flow_id, round((duration - s.md) / coalesce(nullif(s.sd, 0), 1), 9) as duration, "
    "round((src_bytes - s.mb) / coalesce(nullif(s.sb, 0), 1), 9) as src_bytes from flows, "
    "(select avg(duration) as md, stddev_pop(duration) as sd, avg(src_bytes) as mb, "
    " stddev_pop(src_bytes) as sb from flows) s"))
def q_standardize(spark, sf_dir):
    df = flows(spark, sf_dir).select("flow_id", "duration", "src_bytes")
    out = Scaler(["duration", "src_bytes"], with_mean=True).fit(df).transform(df)
    return out.select("flow_id", round_d("duration").alias("duration"), round_d("src_bytes").alias("src_bytes"))


_OH_COLS = "select flow_id, split, proto, service, cast(cast(src_port as bigint) % 997 as varchar) as port_mod from flows"


@query("onehot_rare", with_views(
    'select t.flow_id, t."column", case when c.n >= 10 then t.value else \'__infrequent__\' end as category '
    'from lt t join (select "column", value, count(*) as n from lt where split = \'train\' and value is not null '
    'group by all) c using ("column", value) where t.split = \'test\'',
    ("oh", _OH_COLS),
    ("lt", "select flow_id, split, 'proto' as \"column\", coalesce(proto, 'missing') as value from oh union all "
           "select flow_id, split, 'service', coalesce(service, 'missing') from oh union all "
           "select flow_id, split, 'port_mod', coalesce(port_mod, 'missing') from oh")))
def q_onehot_rare(spark, sf_dir):
    df = flows(spark, sf_dir).select(
        "flow_id", "split", "proto", "service",
        (F.col("src_port").cast("bigint") % 997).cast("string").alias("port_mod"))
    enc = RareOneHot(["proto", "service", "port_mod"], min_frequency=10).fit(df.where("split = 'train'"))
    return enc.transform_long(df.where("split = 'test'"), ["flow_id"])


def _small_design(df):
    return df.select("flow_id", F.array(
        F.log1p("duration"), F.log1p("src_bytes"), well_known_flag("src_port").cast("double"),
        well_known_flag("dst_port").cast("double"), (F.col("proto") == "tcp").cast("double"),
        (F.col("proto") == "udp").cast("double")).alias("x"))


@query("gram_matrix", with_views(
    "select a.i, b.i as j, round(sum(a.v * b.v), 6) as v from el a join el b "
    "on a.flow_id = b.flow_id and a.i <= b.i group by all",
    ("dz", "select flow_id, [ln(1 + duration), ln(1 + src_bytes), "
           "cast(cast(coalesce(src_port < 1024, false) as tinyint) as double), "
           "cast(cast(coalesce(dst_port < 1024, false) as tinyint) as double), "
           "case when proto = 'tcp' then 1.0 else 0.0 end, case when proto = 'udp' then 1.0 else 0.0 end] as x "
           "from flows"),
    ("el", "select flow_id, unnest(x) as v, cast(generate_subscripts(x, 1) - 1 as bigint) as i from dz")))
def q_gram_matrix(spark, sf_dir):
    g = reduce.gram_long(_small_design(flows(spark, sf_dir)), "x", 6)
    return g.select("i", "j", F.round("v", 6).alias("v"))


def _embedder(spark, sf_dir, k=50):
    df = flows(spark, sf_dir)
    return df, reduce.FlowEmbedder(k=k).fit(df.where(F.col("split") == "train"))


def _embedded(spark, sf_dir, keep=("flow_id", "split", "type", "label"), k=50):
    """Embedding of every flow, written once (many jobs read it)."""
    from flowlens.operators.store import materialize
    df, emb = _embedder(spark, sf_dir, k)
    return df, emb, materialize(emb.transform(df, keep=keep), "emb")


@query("embed_flows")
def q_embed_flows(spark, sf_dir):
    """Flow embedding fit on the train split, applied to every flow (ENC-4/6)."""
    df, emb = _embedder(spark, sf_dir)
    return emb.transform(df, keep=("flow_id", "split", "type", "label"))


@query("explained_variance")
def q_explained_variance(spark, sf_dir):
    df, emb = _embedder(spark, sf_dir)
    train = df.where(F.col("split") == "train")
    design = emb.design(train)
    z = reduce.project(design, "x", emb.svd.components, "emb")
    return reduce.explained_variance(design, "x", z, "emb", emb.d, emb.k)


@query("svd_2d")
def q_svd_2d(spark, sf_dir):
    """Two leading embedding dims per flow, with class and cluster (ENC-8)."""
    df, emb = _embedder(spark, sf_dir)
    z = emb.transform(df, keep=("flow_id", "type", "cluster"))
    return z.select(
        "flow_id", F.col("emb")[0].alias("svd1"), F.col("emb")[1].alias("svd2"), "type", "cluster")


# ---- CLU-1..4 ----------------------------------------------------------------------

_VEC_EL = ("el", "select id, label, unnest(vec) as x, cast(generate_subscripts(vec, 1) - 1 as bigint) as i "
                 "from vectors")
_VEC_CENT = ("cent", "select label as cl, i, avg(x) as c from el group by all")
_VEC_DIST = ("dist", "select e.id, e.label, c.cl, sum((e.x - c.c) * (e.x - c.c)) as d2 from el e "
                     "join cent c on e.i = c.i group by all")


def _vec_centroids(spark, sf_dir):
    v = vectors(spark, sf_dir)
    cents = kmeans.label_centroids(v, "vec", "label", 64)
    keys = sorted(cents)
    return v, keys, np.array([cents[k] for k in keys])


@query("kmeans_assign", with_views(
    "select id, arg_min(cl, (d2, cl)) as cluster from dist group by id",
    _VEC_EL, _VEC_CENT, _VEC_DIST, views=("vectors",)))
def q_kmeans_assign(spark, sf_dir):
    v, keys, C = _vec_centroids(spark, sf_dir)
    a = kmeans.assign(v, "vec", C, "_j")
    lut = F.element_at(F.array(*[F.lit(int(k)) for k in keys]), F.col("_j") + 1)
    return a.select("id", lut.alias("cluster"))


@query("inertia", with_views(
    "select round(sum(d2), 6) as inertia from dist where cl = label",
    _VEC_EL, _VEC_CENT, _VEC_DIST, views=("vectors",)))
def q_inertia(spark, sf_dir):
    v, keys, C = _vec_centroids(spark, sf_dir)
    ct = spark.createDataFrame([(int(k), [float(x) for x in C[i]]) for i, k in enumerate(keys)],
                               "label int, _c array<double>")
    from flowlens.functions.vectors import sq_dist_expr
    d = v.join(F.broadcast(ct), "label").select(sq_dist_expr("vec", "_c").alias("d2"))
    return d.agg(F.round(F.sum("d2"), 6).alias("inertia"))


def _lloyd_sql(k: int = 5, steps: int = 3) -> str:
    ctes = [_VEC_EL,
            ("init", f"select id, row_number() over (order by md5(concat(cast(id as varchar), '42')), id) - 1 "
                     f"as cl from vectors qualify cl < {k}"),
            ("c0", "select init.cl, e.i, e.x as c from init join el e using (id)")]
    for s in range(1, steps + 1):
        ctes += [
            (f"d{s}", f"select e.id, c.cl, sum((e.x - c.c) * (e.x - c.c)) as d2 from el e "
                      f"join c{s - 1} c on e.i = c.i group by all"),
            (f"a{s}", f"select id, arg_min(cl, (d2, cl)) as cl from d{s} group by id"),
            (f"m{s}", f"select a.cl, e.i, sum(e.x) / count(*) as c from a{s} a join el e using (id) group by all"),
            (f"c{s}", f"select p.cl, p.i, coalesce(m.c, p.c) as c from c{s - 1} p "
                      f"left join m{s} m on p.cl = m.cl and p.i = m.i"),
        ]
    return with_views(f"select cast(cl as integer) as cluster, i, round(c, 6) as value from c{steps}",
                      *ctes, views=("vectors",))


@query("kmeans_lloyd", _lloyd_sql())
def q_kmeans_lloyd(spark, sf_dir):
    v = vectors(spark, sf_dir)
    init = np.array([r["vec"] for r in exact_sample(v, 5, seed=42, key="id").collect()])
    c = kmeans.lloyd(v, "vec", init, steps=3)
    rows = [(j, i, float(round(c[j, i], 6))) for j in range(c.shape[0]) for i in range(c.shape[1])]
    return spark.createDataFrame(rows, "cluster int, i bigint, value double")


@query("kmeans_fit")
def q_kmeans_fit(spark, sf_dir):
    """k-means (k=30, best of 10 inits) on the flow embedding; labels for every flow (CLU-1/2)."""
    df, emb, z = _embedded(spark, sf_dir)
    centers, _ = kmeans.fit_kmeans(z.where("split = 'train'"), "emb", k=30, n_init=10)
    return kmeans.assign(z, "emb", centers, "cluster_kmeans").drop("emb")


# ---- EVA-1..3 --------------------------------------------------------------------

@query("silhouette", with_views(
    "select round(avg(case when na <= 1 then 0.0 when greatest(a, b) > 0 then (b - a) / greatest(a, b) "
    "else 0.0 end), 9) as silhouette from sc",
    ("s", "select id, label, vec from vectors order by md5(concat(cast(id as varchar), '42')), id limit 5000"),
    ("e", "select id, label, unnest(vec) as x, generate_subscripts(vec, 1) as i from s"),
    ("pd", "select a.id, a.label as la, b.id as idb, b.label as lb, sqrt(sum((a.x - b.x) * (a.x - b.x))) as d "
           "from e a join e b on a.i = b.i group by all"),
    ("cs", "select label, count(*) as n from s group by label"),
    ("pm", "select p.id, p.la, p.lb, sum(p.d) as sd, c.n as nb from pd p join cs c on c.label = p.lb group by all"),
    ("sc", "select id, la, max(case when lb = la and nb > 1 then sd / (nb - 1) end) as a, "
           "max(case when lb = la then nb end) as na, min(case when lb <> la then sd / nb end) as b "
           "from pm group by id, la"), views=("vectors",)))
def q_silhouette(spark, sf_dir):
    v = vectors(spark, sf_dir)
    s = internal.silhouette(v, "vec", "label", "id", sample_n=5000, seed=42)
    return spark.createDataFrame([(None if s is None else round(s, 9),)], "silhouette double")


@query("davies_bouldin", with_views(
    "select round(avg(r), 9) as davies_bouldin from (select cd.la, max((sa.s + sb.s) / cd.d) as r from cd "
    "join sm sa on sa.cl = cd.la join sm sb on sb.cl = cd.lb group by cd.la)",
    _VEC_EL, _VEC_CENT, _VEC_DIST,
    ("sm", "select cl, avg(sqrt(d2)) as s from dist where cl = label group by cl"),
    ("cd", "select a.cl as la, b.cl as lb, sqrt(sum((a.c - b.c) * (a.c - b.c))) as d from cent a "
           "join cent b on a.i = b.i and a.cl <> b.cl group by all"), views=("vectors",)))
def q_davies_bouldin(spark, sf_dir):
    v = vectors(spark, sf_dir)
    s = internal.davies_bouldin(v, "vec", "label", 64)
    return spark.createDataFrame([(None if s is None else round(s, 9),)], "davies_bouldin double")


@query("calinski_harabasz", with_views(
    "select round(case when intra = 0 then 1.0 else extra * (n - k) / (intra * (k - 1)) end, 6) "
    "as calinski_harabasz from (select (select count(*) from vectors) as n, "
    "(select count(distinct label) from vectors) as k, "
    "(select sum(cnt * (c - m) * (c - m)) from cent join (select label as cl, count(*) as cnt from vectors "
    " group by 1) using (cl) join (select i, avg(x) as m from el group by i) using (i)) as extra, "
    "(select sum(d2) from dist where cl = label) as intra)",
    _VEC_EL, _VEC_CENT, _VEC_DIST, views=("vectors",)))
def q_calinski_harabasz(spark, sf_dir):
    v = vectors(spark, sf_dir)
    s = internal.calinski_harabasz(v, "vec", "label", 64)
    return spark.createDataFrame([(None if s is None else round(s, 6),)], "calinski_harabasz double")


# ---- SUP-1..3, 7; SPL-4 ------------------------------------------------------------
from flowlens.operators import classify  # noqa: E402

FOREST = dict(num_trees=150, seed=10000)
SUP_TARGETS = ["cluster", "type", "label"]
CV_FOLDS = 10
SWEEP_KS = range(2, 61)
SUP_EXCLUDE = ["flow_id", "cluster", "y_pred", "ts"]


@query("forest_metrics")
def q_forest_metrics(spark, sf_dir):
    """Forests for cluster / type / label fit on train, scored on valid and test (SUP-7)."""
    df = flows(spark, sf_dir)
    design = classify.SupervisedDesign(SUP_TARGETS, SUP_EXCLUDE).fit(df.where("split = 'train'"))
    preds = classify.evaluate_targets(design, df, **FOREST)
    gm = classify.stacked_metrics(preds)
    return gm.withColumn("target", F.when(F.col("target") == "cluster", "cluster_kmeans30")
                         .otherwise(F.col("target")))


@query("grouped_cv")
def q_grouped_cv(spark, sf_dir):
    """Grouped 10-fold CV macro-F1 of each target's forest on the train split (SPL-4)."""
    df = flows(spark, sf_dir).where("split = 'train'")
    folds = []
    for target in SUP_TARGETS:
        own = splits.group_folds(df, target, k=CV_FOLDS, seed=10000).select("flow_id", F.col("fold").alias(f"fold_{target}"))
        df = df.join(own, "flow_id")
        folds.append(f"fold_{target}")
    rows = classify.grouped_cv(df, SUP_TARGETS, folds, CV_FOLDS, SUP_EXCLUDE, **FOREST)
    return spark.createDataFrame([(t, mean, std, len(scores)) for t, mean, std, scores in rows],
                                 "target string, macroF1_mean double, macroF1_std double, n_folds int")


@query("kmeans_sweep")
def q_kmeans_sweep(spark, sf_dir):
    """k = 2..60 on the flow embedding, one metric row per k (CLU-4, EVA-1..10)."""
    from flowlens.plans.exploratory import kmeans_sweep
    _, _, z = _embedded(spark, sf_dir, keep=("flow_id", "type", "label"))
    return kmeans_sweep(z, SWEEP_KS, n_init=10, silhouette_n=5000)


@query("two_phase_external")
def q_two_phase_external(spark, sf_dir):
    """End-to-end unsupervised phase (own split, embedding, k-means k=30) and
    its external scores per split x target (N2 section 4)."""
    from flowlens.plans import two_phase
    art, _, _ = two_phase.unsupervised(flows(spark, sf_dir), k=30, n_components=50, n_init=10,
                                       exclude=("cluster", "y_pred"))
    return two_phase.external_by_split(art)


@query("dbscan_sweep")
def q_dbscan_sweep(spark, sf_dir):
    """eps proposals from the 10-distance curve, DBSCAN per proposal on the flow
    embedding, one metric row each with _all / _no_noise scores (CLU-13, EVA-10)."""
    from flowlens.plans.exploratory import dbscan_sweep
    _, _, z = _embedded(spark, sf_dir, keep=("flow_id", "type", "label"))
    return dbscan_sweep(z, min_samples=(10, 20, 30), silhouette_n=5000)


@query("hierarchical_sweep")
def q_hierarchical_sweep(spark, sf_dir):
    """3 linkages x 5 cuts on the flow embedding's connected neighbour graph, one metric
    row each (CLU-14, EVA-1..10)."""
    from flowlens.plans.exploratory import hierarchical_sweep
    _, _, z = _embedded(spark, sf_dir, keep=("flow_id", "type", "label"))
    return hierarchical_sweep(z, silhouette_n=5000)
