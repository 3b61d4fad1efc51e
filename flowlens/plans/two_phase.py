"""The two-phase plan end to end (unsupervised then supervised).

split (group-disjoint) -> featurise + embed (fit on train) -> k-means (fit on
train) -> clusters for every split -> external scores per split x target ->
enriched artefact (partitioned by split) -> profile tables of the evaluation
split -> dominant-type classifier -> forests for cluster / type / label.
Every table is a plan over the artefact; sinks are parquet and CSV.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.operators import classify, external, kmeans, profile, reduce, reports, splits
from flowlens.sources.io import read_flows, require_columns, write_csv, write_parquet


def unsupervised(df: DataFrame, k: int = 30, n_components: int = 50, n_init: int = 10, seed: int = 42,
                 id_col: str = "flow_id", exclude=()) -> tuple[DataFrame, object, object]:
    """Rows with ``split`` and ``cluster_kmeans30``; fitted embedder and k-means."""
    from flowlens.operators.store import materialize
    require_columns(df)
    sp = materialize(splits.three_way_split(df.drop("split"), id_col=id_col).drop("grp"), "split")
    train = sp.where(F.col("split") == "train")
    emb = reduce.FlowEmbedder(k=n_components, exclude=(id_col, *exclude)).fit(train)
    z = materialize(emb.transform(sp, keep=(id_col, "split")), "emb")
    centers, _ = kmeans.fit_kmeans(z.where(F.col("split") == "train"), "emb", k, n_init=n_init, seed=seed, key=id_col)
    lab = kmeans.assign(z, "emb", centers, "cluster_kmeans30").select(id_col, "cluster_kmeans30")
    return sp.join(lab, id_col, "left").fillna({"cluster_kmeans30": -1}), emb, centers


def external_by_split(art: DataFrame) -> DataFrame:
    t = F.explode(F.array(F.struct(F.lit("type").alias("target"), F.col("type").cast("string").alias("y")),
                          F.struct(F.lit("label").alias("target"), F.col("label").cast("string").alias("y"))))
    st = art.where(F.col("split") != "none").select("split", "cluster_kmeans30", t.alias("t")).select(
        "split", "t.target", "t.y", "cluster_kmeans30")
    return external.external_scores(st, "y", "cluster_kmeans30", ["split", "target"]).select(
        "split", "target", "ARI", "AMI", "V")


def profile_tables(art: DataFrame, eval_split: str = "test") -> dict[str, DataFrame]:
    ev = art.where(F.col("split") == eval_split)
    long = profile.crosstab_long(ev, "cluster_kmeans30", "type").cache()
    types = sorted(r["type"] for r in long.select("type").distinct().collect())
    pur = profile.purity(long, "cluster_kmeans30", "type")
    sizes = profile.cluster_sizes(art, "cluster_kmeans30")
    fit = art.where(F.col("split").isin("train", "valid"))
    test = art.where(F.col("split") == "test")
    dom = profile.classify_by_map(test, profile.dominant_map(fit, "cluster_kmeans30", "type"), "cluster_kmeans30")
    conf = reports.confusion(dom, "type", "y_pred")
    return {
        "kmeans30_type_por_cluster_contagens": profile.pivot_wide(long, "cluster_kmeans30", "type", types),
        "kmeans30_type_por_cluster_normalizado": profile.pivot_wide(
            profile.row_normalized(long, "cluster_kmeans30").drop("n"), "cluster_kmeans30", "type", types,
            value="share", fill=0.0),
        "kmeans30_pureza_por_cluster": pur.orderBy(F.desc("purity_type"), F.desc("size")),
        "kmeans30_cobertura_vs_limiar_pureza": profile.purity_coverage(pur).orderBy("purity_threshold"),
        "kmeans30_tamanho_clusters": sizes.orderBy("cluster_kmeans30"),
        "kmeans30_tamanho_clusters_por_split": profile.pivot_wide(
            profile.crosstab_long(art, "cluster_kmeans30", "split"), "cluster_kmeans30", "split",
            ["test", "train", "valid"]),
        "kmeans30_histograma_tamanho": profile.size_histogram(sizes),
        "metricas_type_por_cluster_dominante": reports.class_report(conf),
    }


def supervised(art: DataFrame, targets=("cluster_kmeans30", "type", "label"), id_col: str = "flow_id",
               exclude=(), **forest_kw) -> dict[str, DataFrame]:
    design = classify.SupervisedDesign(targets, exclude=(id_col, "grp", *exclude)).fit(art.where(F.col("split") == "train"))
    preds = classify.evaluate_targets(design, art, id_col=id_col, **forest_kw)
    conf = reports.confusion(preds, "y", "p", ["target", "split"])
    return {
        "metricas_globais_supervisionadas": reports.global_metrics(conf, ["target", "split"]),
        "metricas_por_classe": reports.class_report(conf, ["target", "split"]),
        "matriz_confusao_contagens": conf,
        "matriz_confusao_normalizada": reports.confusion_normalized(conf, ["target", "split"]),
    }


def run(spark, source: str, out_dir: str, k: int = 30, n_init: int = 10, num_trees: int = 150, n_components: int = 50) -> None:
    df = read_flows(spark, source)
    art, _, _ = unsupervised(df, k=k, n_init=n_init, n_components=n_components)
    write_parquet(art, f"{out_dir}/artifact.parquet", partition_by="split")
    art = spark.read.parquet(f"{out_dir}/artifact.parquet")
    write_csv(external_by_split(art), f"{out_dir}/metricas_externas_clusters_k30")
    for name, t in {**profile_tables(art), **supervised(art, num_trees=num_trees)}.items():
        write_csv(t, f"{out_dir}/{name}")


if __name__ == "__main__":
    ap = argparse.ArgumentParser()
    ap.add_argument("source")
    ap.add_argument("out_dir")
    ap.add_argument("--k", type=int, default=30)
    a = ap.parse_args()
    from flowlens.session import get_spark
    run(get_spark(), a.source, a.out_dir, k=a.k)
