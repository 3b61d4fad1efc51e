"""External clustering scores from contingency tables (EVA-5..12).

Everything reads the aggregated long-form contingency table
``(group..., u, v, n)``; the row-scale data is scanned once.  Any number of
comparisons (splits x targets, a whole parameter sweep) is scored by one
grouped plan: put the comparison id in ``group`` instead of looping.

Definitions follow the usual ones (adjusted Rand index from pair counts,
adjusted mutual information with arithmetic normalisation and the exact
hypergeometric expected MI, V-measure with beta = 1), including their edge
rules: identical single-class partitions score 1.0, zero-entropy sides give
homogeneity / completeness 1.0.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.functions.columns import log_factorial
from flowlens.operators.store import materialize as written

EPS64 = 2.220446049250313e-16
# Terms of the EMI sum further than this from the hypergeometric mean are
# below double precision (Poisson/normal tail bounds); see emi().
EMI_SIGMAS = 12.0
EMI_SLACK = 40.0


def contingency(df: DataFrame, u: str, v: str, group=()) -> DataFrame:
    """Counts per (group, u, v) (EVA-5).  Null labels form their own class."""
    return (df.select(*group, F.col(u).cast("string").alias("u"), F.col(v).cast("string").alias("v"))
            .groupBy(*group, "u", "v").agg(F.count(F.lit(1)).alias("n")))


def _grouped(ct: DataFrame, group):
    """An empty grouping is one constant group, so every join below is an
    equi-join of aggregated tables on the group key."""
    if group:
        return ct, list(group)
    return ct.withColumn("_all", F.lit(0)), ["_all"]


def _ungrouped(df: DataFrame, group) -> DataFrame:
    return df if group else df.drop("_all")


def _marginals(ct: DataFrame, group, side: str) -> DataFrame:
    return ct.groupBy(*group, side).agg(F.sum("n").alias("m"))


def emi(ct: DataFrame, group=(), written: bool = False) -> DataFrame:
    """Expected mutual information per group under the permutation model.

    Marginals are first collapsed to distinct values with multiplicity, so
    the (a, b) grid is over distinct marginal sizes (at most sqrt(2N) per
    side).  Each (a, b) expands to the admissible n_ij range clipped to
    mean +- (12 sigma + 40): outside it the hypergeometric mass is far below
    1e-16 of the sum, so the result equals the full sum in double precision
    while the term count stays O(sqrt(N)) per pair instead of O(N).  Groups with the
    same margins (shuffles of one labelling, say) are summed once.
    """
    if not written:
        ct = materialize(ct)
    ct, g = _grouped(ct, group)
    tot = ct.groupBy(*g).agg(F.sum("n").cast("double").alias("N"),
                             F.countDistinct("u").alias("R"), F.countDistinct("v").alias("C"))
    a = (_marginals(ct, g, "u").groupBy(*g, "m").agg(F.count(F.lit(1)).alias("ka"))
         .withColumnRenamed("m", "a"))
    b = (_marginals(ct, g, "v").groupBy(*g, "m").agg(F.count(F.lit(1)).alias("kb"))
         .withColumnRenamed("m", "b"))
    # Tables that share both margins share the sum: it is worked out for one of them.
    margin = lambda t, m, k: F.md5(F.to_json(F.sort_array(F.collect_list(F.struct(m, k)))))
    ka = a.groupBy(*g).agg(margin(a, "a", "ka").alias("u_margin"))
    kb = b.groupBy(*g).agg(margin(b, "b", "kb").alias("v_margin"))
    margins = materialize(ka.join(kb, g))
    first = margins.groupBy("u_margin", "v_margin").agg(F.min(F.struct(*g)).alias("first")).select("u_margin", "v_margin", "first.*")
    # Equi-join of two small aggregated tables on the group key.
    ab = a.join(first, g).join(b, g, "inner").join(tot, g, "inner")
    ad, bd, N = F.col("a").cast("double"), F.col("b").cast("double"), F.col("N")
    mu = ad * bd / N
    sigma = F.sqrt(F.greatest(ad * bd * (N - ad) * (N - bd) / (N * N * F.greatest(N - 1, F.lit(1.0))),
                              F.lit(0.0)))
    lo = F.greatest(F.lit(1.0), ad + bd - N, F.floor(mu - EMI_SIGMAS * sigma - EMI_SLACK))
    hi = F.least(ad, bd, F.ceil(mu + EMI_SIGMAS * sigma + EMI_SLACK))
    ex = ab.withColumn("nij", F.explode(F.sequence(lo.cast("bigint"), hi.cast("bigint"))))
    nij = F.col("nij").cast("double")
    gln = (log_factorial(ad) + log_factorial(bd) + log_factorial(N - ad) + log_factorial(N - bd)
           - log_factorial(N) - log_factorial(nij) - log_factorial(ad - nij) - log_factorial(bd - nij)
           - log_factorial(N - ad - bd + nij))
    term = (nij / N) * (F.log(N) + F.log(nij) - F.log(ad) - F.log(bd)) * F.exp(gln)
    s = ex.groupBy("u_margin", "v_margin").agg(F.sum(term * F.col("ka") * F.col("kb")).alias("emi"))
    out = tot.join(margins, g, "left").join(s, ["u_margin", "v_margin"], "left").select(
        *g, F.when((F.col("R") == 1) | (F.col("C") == 1), F.lit(0.0))
        .otherwise(F.coalesce("emi", F.lit(0.0))).alias("emi"))
    return _ungrouped(out, group)


def materialize(ct: DataFrame) -> DataFrame:
    """Write an aggregate-sized table once and read it back: every later
    reference is a parquet leaf instead of a copy of the upstream lineage."""
    from flowlens.operators.store import materialize as _write
    return _write(ct, "ct")


def scores_from_contingency(ct: DataFrame, group=(), with_emi: bool = True,
                            written: bool = False) -> DataFrame:
    """ARI, AMI, V (and MI, entropies) per group from a contingency table."""
    if not written:
        ct = materialize(ct)
    ct, g = _grouped(ct, group)
    a = _marginals(ct, g, "u")
    b = _marginals(ct, g, "v")
    ua = a.groupBy(*g).agg(F.sum(F.col("m").cast("double") ** 2).alias("sa2"),
                           F.count(F.lit(1)).alias("R"), F.sum("m").cast("double").alias("N"))
    vb = b.groupBy(*g).agg(F.sum(F.col("m").cast("double") ** 2).alias("sb2"),
                           F.count(F.lit(1)).alias("C"))
    cells = (ct.join(a.withColumnRenamed("m", "a"), [*g, "u"]).join(b.withColumnRenamed("m", "b"), [*g, "v"]))
    nd = F.col("n").cast("double")
    cell_aggs = cells.groupBy(*g).agg(
        F.sum(nd * nd).alias("sn2"),
        F.sum(nd * (F.log(nd) - F.log(F.col("a").cast("double")) - F.log(F.col("b").cast("double"))))
         .alias("mi_raw"))
    hu = a.groupBy(*g).agg(F.sum(F.col("m").cast("double") * F.log(F.col("m").cast("double"))).alias("alogA"))
    hv = b.groupBy(*g).agg(F.sum(F.col("m").cast("double") * F.log(F.col("m").cast("double"))).alias("blogB"))
    t = ua.join(vb, g).join(cell_aggs, g).join(hu, g).join(hv, g)
    N = F.col("N")
    # Pair confusion (ordered pairs), as doubles: N^2 overflows bigint at scale.
    tp = F.col("sn2") - N
    fp = F.col("sb2") - F.col("sn2")
    fn = F.col("sa2") - F.col("sn2")
    tn = N * N - fp - fn - F.col("sn2")
    ari = F.when((fn == 0) & (fp == 0), F.lit(1.0)).otherwise(
        2.0 * (tp * tn - fn * fp) / ((tp + fn) * (fn + tn) + (tp + fp) * (fp + tn)))
    mi = F.greatest(F.col("mi_raw") / N + F.log(N), F.lit(0.0))
    h_u = F.when(F.col("R") == 1, F.lit(0.0)).otherwise(F.log(N) - F.col("alogA") / N)
    h_v = F.when(F.col("C") == 1, F.lit(0.0)).otherwise(F.log(N) - F.col("blogB") / N)
    t = t.select(*g, "R", "C", "N", ari.alias("ARI"), mi.alias("MI"), h_u.alias("H_u"), h_v.alias("H_v"))
    hom = F.when(F.col("H_u") == 0, F.lit(1.0)).otherwise(F.col("MI") / F.col("H_u"))
    com = F.when(F.col("H_v") == 0, F.lit(1.0)).otherwise(F.col("MI") / F.col("H_v"))
    t = t.withColumn("V", F.when(hom + com == 0, F.lit(0.0)).otherwise(2.0 * hom * com / (hom + com)))
    if with_emi:
        t = t.join(emi(ct, g, written=True), g)
        den = (F.col("H_u") + F.col("H_v")) / 2.0 - F.col("emi")
        den = F.when(den < 0, F.least(den, F.lit(-EPS64))).otherwise(F.greatest(den, F.lit(EPS64)))
        t = t.withColumn("AMI", F.when((F.col("R") == 1) & (F.col("C") == 1), F.lit(1.0))
                         .otherwise((F.col("MI") - F.col("emi")) / den))
    return _ungrouped(t, group)


def external_scores(df: DataFrame, truth: str, pred: str, group=()) -> DataFrame:
    """ARI / AMI / V of ``pred`` against ``truth`` per group (EVA-6..8, 12)."""
    return scores_from_contingency(contingency(df, truth, pred, group), group)


def noise_summary(df: DataFrame, pred: str, group=()) -> DataFrame:
    """Noise share and number of non-noise clusters per group (EVA-10)."""
    return df.groupBy(*group).agg(
        F.avg(F.when(F.col(pred) == -1, 1.0).otherwise(0.0)).alias("noise_ratio"),
        F.countDistinct(F.when(F.col(pred) != -1, F.col(pred))).alias("n_clusters"),
        F.count(F.lit(1)).alias("n_points"))


def cluster_size_stats(df: DataFrame, pred: str, group=()) -> DataFrame:
    """min, 1st percentile (linear), #<10, #<50, max of cluster sizes, noise
    excluded (EVA-9).  Groups whose points are all noise are absent here and
    reported as zeros by the caller (``with_size_defaults``)."""
    return size_stats(df.where(F.col(pred) != -1).groupBy(*group, pred).agg(F.count(F.lit(1)).alias("sz")), group)


def size_stats(sizes: DataFrame, group=()) -> DataFrame:
    """``cluster_size_stats`` from each cluster's size ``sz``."""
    return sizes.groupBy(*group).agg(
        F.min("sz").alias("min_size"),
        F.percentile(F.col("sz").cast("double"), 0.01).alias("p1_size"),
        F.sum(F.when(F.col("sz") < 10, 1).otherwise(0)).cast("bigint").alias("n_small_lt_10"),
        F.sum(F.when(F.col("sz") < 50, 1).otherwise(0)).cast("bigint").alias("n_small_lt_50"),
        F.max("sz").alias("max_size"))


def with_size_defaults(df: DataFrame) -> DataFrame:
    return df.fillna({"min_size": 0, "p1_size": 0.0, "n_small_lt_10": 0, "n_small_lt_50": 0,
                      "max_size": 0})


def hypergeometric(good: int, total: int, draws: int, rng) -> int:
    """Exact draw of the good ones among ``draws`` out of ``total`` without
    replacement, for totals of any size: inversion over mean +- (12 sigma + 40),
    outside which the mass is below double precision.  Probabilities come from
    the ratios of neighbouring terms, so nothing cancels."""
    import numpy as np

    lo, hi = max(0, draws - (total - good)), min(draws, good)
    if lo == hi:
        return lo
    mean = draws * (good / total)
    sd = math.sqrt(max(0.0, mean * (1 - good / total) * ((total - draws) / max(total - 1, 1))))
    lo, hi = max(lo, int(mean - 12 * sd - 40)), min(hi, int(mean + 12 * sd + 40))
    x = np.arange(lo, hi, dtype=np.float64)
    up = np.log((good - x) * ((draws - x) / ((x + 1) * (total - good - draws + x + 1))))
    logp = np.append(0.0, np.cumsum(up))
    cdf = np.cumsum(np.exp(logp - logp.max()))
    return lo + min(int(np.searchsorted(cdf, rng.random() * cdf[-1], "right")), hi - lo)


def permutation_test(df: DataFrame, truth: str, pred: str, replicates: int = 199, seed: int = 42,
                     metrics=("AMI", "V")) -> DataFrame:
    """Observed score vs ``replicates`` label shuffles; p = (1 + #{perm >= obs}) / (B + 1) (EVA-11).

    Shuffling one labelling leaves both margins fixed and makes the
    contingency table multivariate-hypergeometric given them, so replicate
    tables are drawn from the R + C margins: the rows are scanned once (for the
    observed table) however large B is.  The replicates are drawn in Spark
    tasks, each from a generator of its own, and scored by one grouped plan.
    """
    spark = df.sparkSession
    ct = written(contingency(df, truth, pred), "observed")
    a = sorted((r["u"], r["m"]) for r in _marginals(ct, [], "u").collect())
    b = sorted((r["v"], r["m"]) for r in _marginals(ct, [], "v").collect())

    def draw(batches):
        import numpy as np
        import pandas as pd

        for batch in batches:
            for rep in batch["rep"].tolist():
                rng = np.random.default_rng([seed, rep])
                left, rows = [m for _, m in b], []
                for u, size in a:
                    total = sum(left)
                    for j, (v, _) in enumerate(b):
                        n = hypergeometric(left[j], total, size, rng) if size else 0
                        total -= left[j]
                        size -= n
                        left[j] -= n
                        if n:
                            rows.append((rep, u, v, n))
                yield pd.DataFrame(rows, columns=["rep", "u", "v", "n"])

    reps = spark.range(1, replicates + 1, numPartitions=min(replicates, 64)).withColumnRenamed("id", "rep")
    sim = written(reps.mapInPandas(draw, "rep long, u string, v string, n bigint"), "replicates")
    # the observed table is replicate 0: all share their margins, hence one EMI
    every = scores_from_contingency(ct.withColumn("rep", F.lit(0).cast("long")).unionByName(sim), ["rep"])
    every = written(every.select("rep", *metrics), "permuted")
    obs, perm = every.where("rep = 0").first(), every.where("rep > 0")
    agg = perm.agg(*[F.sum(F.when(F.col(m) >= F.lit(obs[m]) - 1e-12, 1).otherwise(0)).alias(m) for m in metrics]
                   ).first()
    out = [(m, float(obs[m]), (1.0 + agg[m]) / (replicates + 1.0), replicates) for m in metrics]
    return spark.createDataFrame(out, "metric string, observed double, p_value double, replicates int")
