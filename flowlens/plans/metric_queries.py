"""Scoring, profiling, report and comparison queries (EVA, PRO, SUP-4..8, CMP)."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.functions.columns import round_d
from flowlens.operators import compare, external, profile, reports
from flowlens.plans.oracle_sql import external_ctes, global_metrics_sql, report_ctes
from flowlens.plans.registry import query
from flowlens.sources.fixtures import flows, with_views

# The fixture's class names (only the oracle's wide pivots list them).
FIXTURE_TYPES = ["click", "error", "purchase", "signup", "view"]
R9 = 9


def _r(df, cols):
    return df.withColumns({c: round_d(c, R9) for c in cols})


def _targets(df, cluster="cluster"):
    """(target, y, cluster) stacked for targets type and label."""
    t = F.explode(F.array(
        F.struct(F.lit("type").alias("target"), F.col("type").cast("string").alias("y")),
        F.struct(F.lit("label").alias("target"), F.col("label").cast("string").alias("y"))))
    return df.select("*", t.alias("_t")).select("*", "_t.target", "_t.y").drop("_t")


_STACK_SQL = ("select 'type' as target, split, type as u, cast(cluster as varchar) as v from flows "
              "union all select 'label' as target, split, cast(label as varchar) as u, "
              "cast(cluster as varchar) as v from flows")


def _ext_sql(select: str, g: list[str], ct_body: str) -> str:
    return with_views(select, ("ct", ct_body), *external_ctes("ct", g))


# ---- EVA ---------------------------------------------------------------------------

@query("contingency", with_views("select type, cluster, count(*) as n from flows group by all"))
def q_contingency(spark, sf_dir):
    return profile.crosstab_long(flows(spark, sf_dir), "type", "cluster")


def _ext_targets(spark, sf_dir, group=("target",)):
    st = _targets(flows(spark, sf_dir))
    return external.external_scores(st, "y", "cluster", list(group))


_CT_TARGET = f"select target, u, v, count(*) as n from ({_STACK_SQL}) group by all"


@query("ari", _ext_sql("select target, round(ARI, 9) as ARI from scores", ["target"], _CT_TARGET))
def q_ari(spark, sf_dir):
    return _r(_ext_targets(spark, sf_dir).select("target", "ARI"), ["ARI"])


@query("ami", _ext_sql("select target, round(AMI, 9) as AMI from scores", ["target"], _CT_TARGET))
def q_ami(spark, sf_dir):
    return _r(_ext_targets(spark, sf_dir).select("target", "AMI"), ["AMI"])


@query("v_measure", _ext_sql("select target, round(V, 9) as V from scores", ["target"], _CT_TARGET))
def q_v(spark, sf_dir):
    return _r(_ext_targets(spark, sf_dir).select("target", "V"), ["V"])


@query("external_by_split", _ext_sql(
    "select split, target, round(ARI, 9) as ARI, round(AMI, 9) as AMI, round(V, 9) as V from scores",
    ["split", "target"], f"select split, target, u, v, count(*) as n from ({_STACK_SQL}) group by all"))
def q_external_by_split(spark, sf_dir):
    s = _ext_targets(spark, sf_dir, ("split", "target"))
    return _r(s.select("split", "target", "ARI", "AMI", "V"), ["ARI", "AMI", "V"])


_NOISE_CT = ("select variant, u, v, count(*) as n from ("
             "select 'all' as variant, type as u, cast(cluster as varchar) as v from flows union all "
             "select 'no_noise' as variant, type as u, cast(cluster as varchar) as v from flows "
             "where cluster <> -1) group by all")


@query("eva_no_noise", _ext_sql(
    "select s.variant, round(ns.noise_ratio, 9) as noise_ratio, ns.n_clusters, "
    "case when ok then round(ARI, 9) end as ARI_type, case when ok then round(AMI, 9) end as AMI_type, "
    "case when ok then round(V, 9) end as V_type from scores s, "
    "(select avg(case when cluster = -1 then 1.0 else 0.0 end) as noise_ratio, "
    " count(distinct case when cluster <> -1 then cluster end) as n_clusters from flows) ns, "
    "(select 'all' as variant, true as ok union all select 'no_noise', "
    " count(*) filter (where cluster <> -1) >= 2 and count(distinct cluster) filter (where cluster <> -1) >= 2 "
    " from flows) g where g.variant = s.variant", ["variant"], _NOISE_CT))
def q_eva_no_noise(spark, sf_dir):
    df = flows(spark, sf_dir)
    v = F.explode(F.when(F.col("cluster") != -1, F.array(F.lit("all"), F.lit("no_noise")))
                  .otherwise(F.array(F.lit("all"))))
    stacked = df.select("type", "cluster", v.alias("variant"))
    sc = external.external_scores(stacked, "type", "cluster", ["variant"])
    ns = external.noise_summary(df.withColumn("variant", F.lit("all")), "cluster", ["variant"])
    guard = (stacked.groupBy("variant").agg(F.count(F.lit(1)).alias("rows_left"),
                                            F.countDistinct("cluster").alias("clusters_left")))
    ok = (F.col("variant") == "all") | ((F.col("rows_left") >= 2) & (F.col("clusters_left") >= 2))
    out = sc.join(guard, "variant").select(
        "variant", *[F.when(ok, round_d(c)).alias(f"{c}_type") for c in ("ARI", "AMI", "V")])
    summ = ns.select(round_d("noise_ratio").alias("noise_ratio"), "n_clusters")
    # One-row summary attached to both variant rows through a broadcast lookup.
    return out.join(F.broadcast(summ.withColumn("_k", F.lit(1))),
                    F.lit(1) == F.col("_k")).drop("_k").select(
        "variant", "noise_ratio", "n_clusters", "ARI_type", "AMI_type", "V_type")


@query("cluster_size_stats", with_views(
    "select min(sz) as min_size, round(quantile_cont(sz, 0.01), 9) as p1_size, "
    "cast(sum(case when sz < 10 then 1 else 0 end) as bigint) as n_small_lt_10, "
    "cast(sum(case when sz < 50 then 1 else 0 end) as bigint) as n_small_lt_50, max(sz) as max_size "
    "from (select cluster, count(*) as sz from flows where cluster <> -1 group by 1)"))
def q_cluster_size_stats(spark, sf_dir):
    st = external.cluster_size_stats(flows(spark, sf_dir), "cluster")
    return external.with_size_defaults(_r(st, ["p1_size"]))


# ---- PRO ---------------------------------------------------------------------------

def _test_rows(spark, sf_dir):
    return flows(spark, sf_dir).where(F.col("split") == "test")


@query("crosstab_type", with_views(
    "select cluster, " + ", ".join(f"cast(sum(case when type = '{t}' then 1 else 0 end) as bigint) as {t}"
                                   for t in FIXTURE_TYPES) +
    " from flows where split = 'test' group by cluster"))
def q_crosstab_type(spark, sf_dir):
    long = profile.crosstab_long(_test_rows(spark, sf_dir), "cluster", "type")
    values = sorted(r["type"] for r in long.select("type").distinct().collect())
    return profile.pivot_wide(long, "cluster", "type", values)


@query("crosstab_norm", with_views(
    "select cluster, type, round(n / sum(n) over (partition by cluster), 9) as share "
    "from (select cluster, type, count(*) as n from flows where split = 'test' group by all)"))
def q_crosstab_norm(spark, sf_dir):
    long = profile.crosstab_long(_test_rows(spark, sf_dir), "cluster", "type")
    return _r(profile.row_normalized(long, "cluster").select("cluster", "type", "share"), ["share"])


_PURITY_SQL = ("select cluster, max(n) / sum(n) as purity_type, cast(sum(n) as bigint) as size, "
               "arg_min(type, (-n, type)) as dominant_type from "
               "(select cluster, type, count(*) as n from flows where {w} group by all) group by cluster")


@query("cluster_purity", with_views(
    "select cluster, round(purity_type, 9) as purity_type, size, dominant_type from p",
    ("p", _PURITY_SQL.format(w="split = 'test'"))))
def q_cluster_purity(spark, sf_dir):
    long = profile.crosstab_long(_test_rows(spark, sf_dir), "cluster", "type")
    return _r(profile.purity(long, "cluster", "type"), ["purity_type"])


@query("purity_coverage", with_views(
    "select round(t, 9) as purity_threshold, round(sum(case when purity_type >= t then size else 0 end) "
    "/ sum(size), 9) as coverage from p, (select cast(0.5 as double) + i * cast(0.01 as double) as t from range(51) r(i)) th group by t",
    ("p", _PURITY_SQL.format(w="split = 'test'"))))
def q_purity_coverage(spark, sf_dir):
    long = profile.crosstab_long(_test_rows(spark, sf_dir), "cluster", "type")
    cov = profile.purity_coverage(profile.purity(long, "cluster", "type"))
    return _r(cov, ["purity_threshold", "coverage"])


@query("cluster_sizes", with_views("select cluster, count(*) as size from flows group by 1"))
def q_cluster_sizes(spark, sf_dir):
    return profile.cluster_sizes(flows(spark, sf_dir), "cluster")


@query("sizes_by_split", with_views(
    "select cluster, " + ", ".join(f"cast(sum(case when split = '{s}' then 1 else 0 end) as bigint) as {s}"
                                   for s in ("test", "train", "valid")) + " from flows group by 1"))
def q_sizes_by_split(spark, sf_dir):
    long = profile.crosstab_long(flows(spark, sf_dir), "cluster", "split")
    return profile.pivot_wide(long, "cluster", "split", ["test", "train", "valid"])


@query("size_histogram", with_views(
    "select cast(b.i as integer) as bin, round(lo + b.i * (hi - lo) / 15, 9) as bin_lo, "
    "round(lo + (b.i + 1) * (hi - lo) / 15, 9) as bin_hi, "
    "cast(count(s.x) as bigint) as n from "
    "(select case when min(size) = max(size) then min(size) - 0.5 else min(size) end::double as lo, "
    " case when min(size) = max(size) then max(size) + 0.5 else max(size) end::double as hi from sz) m "
    "cross join range(15) b(i) "
    "left join (select size::double as x from sz) s on "
    "least(floor((s.x - m.lo) * 15 / (m.hi - m.lo)), 14) = b.i group by all",
    ("sz", "select cluster, count(*) as size from flows group by 1")))
def q_size_histogram(spark, sf_dir):
    sizes = profile.cluster_sizes(flows(spark, sf_dir), "cluster")
    return _r(profile.size_histogram(sizes), ["bin_lo", "bin_hi"])


@query("dominant_map", with_views(
    "select cluster, dominant_type from p", ("p", _PURITY_SQL.format(w="split in ('train', 'valid')"))))
def q_dominant_map(spark, sf_dir):
    df = flows(spark, sf_dir).where(F.col("split").isin("train", "valid"))
    return profile.dominant_map(df, "cluster", "type")


@query("dominant_classify", with_views(
    "select f.flow_id, f.type, coalesce(p.dominant_type, 'unknown') as y_pred_dom from flows f "
    "left join p on f.cluster = p.cluster where f.split = 'test'",
    ("p", _PURITY_SQL.format(w="split in ('train', 'valid')"))))
def q_dominant_classify(spark, sf_dir):
    df = flows(spark, sf_dir)
    fit = df.where(F.col("split").isin("train", "valid"))
    m = profile.dominant_map(fit, "cluster", "type")
    test = df.where(F.col("split") == "test").select("flow_id", "type", "cluster")
    return profile.classify_by_map(test, m, "cluster", out="y_pred_dom").select("flow_id", "type", "y_pred_dom")


@query("split_summary", with_views(
    "select split, count(*) as n_rows, count(distinct type) as n_types, count(distinct label) as n_labels "
    "from flows group by 1"))
def q_split_summary(spark, sf_dir):
    return profile.split_summary(flows(spark, sf_dir))


# ---- SUP reports -------------------------------------------------------------------

@query("class_weights", with_views(
    "select type, round(sum(n) over () / (count(*) over () * n), 9) as weight from "
    "(select type, count(*) as n from flows where split = 'train' group by 1)"))
def q_class_weights(spark, sf_dir):
    df = flows(spark, sf_dir).where(F.col("split") == "train")
    return _r(reports.class_weights(df, "type"), ["weight"])


_CONF_SQL = ("select split, type as y, y_pred as p, count(*) as n from flows "
             "where split in ('valid', 'test') group by all")


def _conf(spark, sf_dir):
    df = flows(spark, sf_dir).where(F.col("split").isin("valid", "test"))
    return reports.confusion(df, "type", "y_pred", ["split"])


@query("confusion", with_views(_CONF_SQL))
def q_confusion(spark, sf_dir):
    return _conf(spark, sf_dir)


@query("confusion_norm", with_views(
    "select split, y, p, round(n / greatest(sum(n) over (partition by split, y), 1), 9) as share "
    "from conf", ("conf", _CONF_SQL)))
def q_confusion_norm(spark, sf_dir):
    return _r(reports.confusion_normalized(_conf(spark, sf_dir), ["split"]).drop("n"), ["share"])


_REPORT_SQL = (
    "select split, class, round(precision, 9) as precision, round(recall, 9) as recall, "
    "round(f1_score, 9) as f1_score, cast(support as double) as support from pcm union all "
    "select split, 'accuracy', round(a, 9), round(a, 9), round(a, 9), round(a, 9) from "
    "(select split, sum(tp) / sum(support) as a from pcm group by 1) union all "
    "select split, 'macro avg', round(avg(precision), 9), round(avg(recall), 9), round(avg(f1_score), 9), "
    "cast(sum(support) as double) from pcm group by 1 union all "
    "select split, 'weighted avg', round(sum(precision * support) / sum(support), 9), "
    "round(sum(recall * support) / sum(support), 9), round(sum(f1_score * support) / sum(support), 9), "
    "cast(sum(support) as double) from pcm group by 1")


@query("class_report", with_views(_REPORT_SQL, ("conf", _CONF_SQL), *report_ctes("conf", ["split"])))
def q_class_report(spark, sf_dir):
    rep = reports.class_report(_conf(spark, sf_dir), ["split"])
    return _r(rep, ["precision", "recall", "f1_score", "support"])


@query("global_metrics", with_views(global_metrics_sql(["split"]), ("conf", _CONF_SQL),
                                    *report_ctes("conf", ["split"])))
def q_global_metrics(spark, sf_dir):
    gm = reports.global_metrics(_conf(spark, sf_dir), ["split"])
    return _r(gm, ["accuracy", "balanced_accuracy", "macroF1", "weightedF1", "MCC"])


_STACKED_CONF = (
    "select target, split, y, p, count(*) as n from ("
    "select 'type' as target, split, type as y, y_pred as p from flows union all "
    "select 'label', split, cast(label as varchar), case when y_pred = 'view' then '0' else '1' end from flows "
    "union all select 'cluster_kmeans30', split, cast(cluster as varchar), "
    "cast(case when flow_id % 19 = 0 then (cluster + 1) % 12 else cluster end as varchar) from flows"
    ") where split in ('valid', 'test') group by all")


@query("global_metrics_stacked", with_views(global_metrics_sql(["target", "split"]), ("conf", _STACKED_CONF),
                                            *report_ctes("conf", ["target", "split"])))
def q_global_metrics_stacked(spark, sf_dir):
    df = flows(spark, sf_dir).where(F.col("split").isin("valid", "test"))
    t = F.explode(F.array(
        F.struct(F.lit("type").alias("target"), F.col("type").alias("yt"), F.col("y_pred").alias("yp")),
        F.struct(F.lit("label").alias("target"), F.col("label").cast("string").alias("yt"),
                 F.when(F.col("y_pred") == "view", "0").otherwise("1").alias("yp")),
        F.struct(F.lit("cluster_kmeans30").alias("target"), F.col("cluster").cast("string").alias("yt"),
                 F.when(F.col("flow_id") % 19 == 0, (F.col("cluster") + 1) % 12)
                 .otherwise(F.col("cluster")).cast("string").alias("yp"))))
    preds = df.select("split", t.alias("t")).select("t.target", "split", "t.yt", "t.yp")
    conf = reports.confusion(preds, "yt", "yp", ["target", "split"])
    gm = reports.global_metrics(conf, ["target", "split"])
    return _r(gm, ["accuracy", "balanced_accuracy", "macroF1", "weightedF1", "MCC"])


@query("f1_ranking", with_views(
    "select split, class, round(f1_score, 9) as f1_score, "
    "row_number() over (partition by split order by f1_score desc, class asc) as rank from pcm",
    ("conf", _CONF_SQL), *report_ctes("conf", ["split"])))
def q_f1_ranking(spark, sf_dir):
    rep = reports.class_report(_conf(spark, sf_dir), ["split"])
    rk = reports.f1_ranking(rep, ["split"]).select("split", "class", round_d("f1_score").alias("f1_score"),
                                                    F.col("rank"))
    return rk.withColumn("rank", F.col("rank").cast("bigint"))


# ---- CMP: a parameter sweep scored in one grouped job ---------------------------------
# Candidate partitions of the flows (stand-ins for k-means / DBSCAN / hierarchical
# outputs) are generated per row from a parameter grid; all of them are scored by
# one contingency aggregation grouped by candidate, then compared.

# The sweep grid (cid, algo, k, eps index e, min_samples, linkage, offset).
SWEEP = ([(i, "KMeans", k, 0, 0, "", 0) for i, k in enumerate([2, 3, 4, 6, 12])]
         + [(5 + 2 * (e - 1) + j, "DBSCAN", 0, e, ms, "", 0)
            for e in (1, 2, 3) for j, ms in enumerate((10, 20))]
         + [(11 + 3 * li + ki, "Hierarchical", k, 0, 0, lk, li)
            for li, lk in enumerate(["ward", "average", "complete"]) for ki, k in enumerate([3, 4, 6])])
EXT_COLS = ["ARI_type", "AMI_type", "V_type", "ARI_label", "AMI_label", "V_label"]


def _sweep_label():
    c, k, e, ms, off = (F.col("cluster"), F.col("c.k"), F.col("c.e"), F.col("c.ms"), F.col("c.off"))
    return (F.when(F.col("c.algo") == "KMeans", F.pmod(c, k))
            .when(F.col("c.algo") == "DBSCAN",
                  F.when(F.col("flow_id") % ms < e, F.lit(-1)).otherwise(F.pmod(c, e + 6)))
            .otherwise(F.pmod(c + off, k)))


def sweep_tables(spark, sf_dir):
    """(kmeans, dbscan, hierarchical) metric tables of the candidate sweep."""
    df = flows(spark, sf_dir).select("flow_id", "cluster", "type", "label")
    grid = F.array(*[F.struct(F.lit(cid).alias("cid"), F.lit(a).alias("algo"), F.lit(k).alias("k"),
                              F.lit(e).alias("e"), F.lit(ms).alias("ms"), F.lit(off).alias("off"))
                     for cid, a, k, e, ms, _, off in SWEEP])
    lab = df.select("flow_id", "cluster", "type", "label", F.explode(grid).alias("c")).select(
        F.col("c.cid").alias("cid"), "type", "label", _sweep_label().alias("lab"))
    # one pass over the exploded rows: the written contingency table feeds
    # both the scores and the noise summary
    ct = external.materialize(external.contingency(_targets(lab, "lab"), "y", "lab", ["cid", "target"]))
    scores = external.scores_from_contingency(ct, ["cid", "target"], written=True)
    wide = scores.groupBy("cid").agg(*[
        F.max(F.when(F.col("target") == t, F.col(m))).alias(f"{m}_{t}")
        for t in ("type", "label") for m in ("ARI", "AMI", "V")])
    ns = ct.where(F.col("target") == "type").groupBy("cid").agg(
        (F.sum(F.when(F.col("v") == "-1", F.col("n")).otherwise(0)) / F.sum("n")).alias("noise_ratio"),
        F.countDistinct(F.when(F.col("v") != "-1", F.col("v"))).alias("n_clusters"))
    params = spark.createDataFrame([(cid, a, k, e, ms, lk) for cid, a, k, e, ms, lk, _ in SWEEP],
                                   "cid int, algo string, k int, e int, min_samples int, linkage string")
    t = params.join(wide, "cid").join(ns, "cid")
    t = t.withColumns({c: round_d(c) for c in EXT_COLS + ["noise_ratio"]})
    km = t.where("algo = 'KMeans'").select("algo", compare.kmeans_param(F.col("k")).alias("param"), "k",
                                           "noise_ratio", *EXT_COLS)
    db = t.where("algo = 'DBSCAN'").select(
        "algo", compare.dbscan_param(F.col("e") * 0.5, F.col("min_samples")).alias("param"),
        (F.col("e") * 0.5).alias("eps"), "min_samples", "n_clusters", "noise_ratio",
        *[F.col(c).alias(f"{c}_all") for c in EXT_COLS])
    hi = t.where("algo = 'Hierarchical'").select(
        "algo", compare.linkage_param(F.col("linkage"), F.col("k")).alias("param"), "linkage", "k",
        "n_clusters", "noise_ratio", *EXT_COLS)
    return km, db, hi


def _sweep_sql(body: str) -> str:
    vals = ", ".join(f"({cid}, '{a}', {k}, {e}, {ms}, '{lk}', {off})" for cid, a, k, e, ms, lk, off in SWEEP)
    lab = ("select c.cid, f.type, cast(f.label as varchar) as lbl, case c.algo "
           "when 'KMeans' then ((f.cluster % c.k) + c.k) % c.k "
           "when 'DBSCAN' then case when f.flow_id % c.ms < c.e then -1 "
           "else ((f.cluster % (c.e + 6)) + c.e + 6) % (c.e + 6) end "
           "else ((f.cluster + c.off) % c.k + c.k) % c.k end as lab from flows f cross join cands c")
    ct = ("select cid, target, u, v, count(*) as n from ("
          "select cid, 'type' as target, type as u, cast(lab as varchar) as v from lab union all "
          "select cid, 'label' as target, lbl as u, cast(lab as varchar) as v from lab) group by all")
    wide = ("select cid, " + ", ".join(
        f"round(max(case when target = '{t}' then {m} end), 9) as {m}_{t}"
        for t in ("type", "label") for m in ("ARI", "AMI", "V")) + " from scores group by cid")
    ns = ("select cid, round(avg(case when lab = -1 then 1.0 else 0.0 end), 9) as noise_ratio, "
          "count(distinct case when lab <> -1 then lab end) as n_clusters from lab group by cid")
    ext = ", ".join(EXT_COLS)
    km = (f"select 'KMeans' as algo, printf('k=%d', k) as param, k, noise_ratio, {ext} "
          f"from cands join wide using (cid) join ns using (cid) where algo = 'KMeans'")
    db = ("select 'DBSCAN' as algo, printf('eps=%.4f, min_samples=%d', e * 0.5, ms) as param, "
          "cast(e * 0.5 as double) as eps, ms as min_samples, n_clusters, noise_ratio, "
          + ", ".join(f"{c} as {c}_all" for c in EXT_COLS) +
          " from cands join wide using (cid) join ns using (cid) where algo = 'DBSCAN'")
    hi = (f"select 'Hierarchical' as algo, printf('linkage=%s, k=%d', linkage, k) as param, linkage, k, "
          f"n_clusters, noise_ratio, {ext} from cands join wide using (cid) join ns using (cid) "
          f"where algo = 'Hierarchical'")
    return with_views(body, ("cands", f"select * from (values {vals}) v(cid, algo, k, e, ms, linkage, off)"),
                      ("lab", lab), ("ct", ct), *external_ctes("ct", ["cid", "target"]), ("wide", wide),
                      ("ns", ns), ("km", km), ("db", db), ("hi", hi),
                      ("um", "select * from km union all by name select * from db "
                             "union all by name select * from hi"))


@query("union_metrics", _sweep_sql("select * from um"))
def q_union_metrics(spark, sf_dir):
    return compare.union_metrics(*sweep_tables(spark, sf_dir))


_BEST_SQL = ("select * exclude (rk) from (select *, row_number() over (partition by algo order by "
             "coalesce(AMI_type, AMI_type_all) desc nulls last, param asc) as rk from um) where rk = 1")


@query("best_per_algo", _sweep_sql(_BEST_SQL))
def q_best_per_algo(spark, sf_dir):
    return compare.best_per_algo(compare.union_metrics(*sweep_tables(spark, sf_dir)))


@query("compare_best", _sweep_sql(
    "select algo, param, concat(algo, chr(10), param) as label, "
    "coalesce(AMI_type, AMI_type_all) as AMI_type_comparavel, coalesce(V_type, V_type_all) as V_type_comparavel, "
    "coalesce(AMI_label, AMI_label_all) as AMI_label_comparavel, "
    "coalesce(V_label, V_label_all) as V_label_comparavel, noise_ratio from (" + _BEST_SQL + ")"))
def q_compare_best(spark, sf_dir):
    best = compare.with_comparable(compare.best_per_algo(compare.union_metrics(*sweep_tables(spark, sf_dir))))
    return best.select("algo", "param", compare.display_label().alias("label"),
                       *[f"{c}_comparavel" for c in compare.COMPARABLE], "noise_ratio")


@query("leaderboard", _sweep_sql(
    "select algo, param, coalesce(AMI_type, AMI_type_all) as AMI_type_comparavel from um "
    "order by AMI_type_comparavel desc nulls last, param asc limit 10"))
def q_leaderboard(spark, sf_dir):
    um = compare.with_comparable(compare.union_metrics(*sweep_tables(spark, sf_dir)))
    return compare.leaderboard(um, "AMI_type_comparavel").select("algo", "param", "AMI_type_comparavel")


_CURVE_METRICS = ["ARI_type", "AMI_type", "V_type", "AMI_label", "noise_ratio"]


@query("metric_curves", _sweep_sql(
    "select k, metric, value from (unpivot (select k, " + ", ".join(f"cast({m} as double) as {m}"
                                                                     for m in _CURVE_METRICS) +
    " from km) on " + ", ".join(_CURVE_METRICS) + " into name metric value value)"))
def q_metric_curves(spark, sf_dir):
    km, _, _ = sweep_tables(spark, sf_dir)
    return compare.metric_curves(km, "k", _CURVE_METRICS)


@query("permutation_test")
def q_permutation_test(spark, sf_dir):
    """Observed AMI / V of cluster vs type against 99 label shuffles (EVA-11)."""
    return external.permutation_test(flows(spark, sf_dir), "type", "cluster", replicates=99, seed=42)
