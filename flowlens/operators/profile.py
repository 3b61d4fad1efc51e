"""Cluster profiling (PRO-1..10).

All tables are plans over the aggregated long contingency ``(cluster, class,
n)``; wide (pivoted) layouts are produced only at the sink, with the pivot
values listed explicitly so Spark does not run an extra distinct job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The purity thresholds 0.50, 0.51, ..., 1.00 (51 steps of 0.01).
PURITY_START, PURITY_STEP, PURITY_STEPS = 0.5, 0.01, 50
# Broadcast a per-cluster lookup only while its measured row count is below this.
MAP_BROADCAST_ROWS = 1_000_000


def crosstab_long(df: DataFrame, row: str, col: str) -> DataFrame:
    """Counts per (row, col) (PRO-1, long form)."""
    return df.groupBy(row, col).agg(F.count(F.lit(1)).alias("n"))


def pivot_wide(long: DataFrame, row: str, col: str, values: list, value: str = "n",
               fill=0) -> DataFrame:
    """Wide crosstab for a sink: one column per value of ``col``."""
    return long.groupBy(row).pivot(col, values).agg(F.first(value)).fillna(fill)


def row_normalized(long: DataFrame, row: str, value: str = "n") -> DataFrame:
    """Share of each cell in its row (PRO-2); the window runs on the aggregated table."""
    tot = F.sum(value).over(Window.partitionBy(row))
    return long.withColumn("share", F.coalesce(F.try_divide(F.col(value).cast("double"), tot),
                                               F.lit(0.0)))


def purity(long: DataFrame, row: str, col: str, dominant: str = "dominant_type",
           purity_col: str = "purity_type") -> DataFrame:
    """Purity = max/total, size, dominant class (ties -> alphabetically first) (PRO-3)."""
    return long.groupBy(row).agg(
        (F.max("n") / F.sum("n")).alias(purity_col),
        F.sum("n").cast("bigint").alias("size"),
        F.min_by(F.col(col), F.struct(-F.col("n"), F.col(col))).alias(dominant))


def purity_coverage(pur: DataFrame, purity_col: str = "purity_type") -> DataFrame:
    """Share of rows in clusters with purity >= t, t = 0.50..1.00 (PRO-4).

    Each cluster row expands to the 51 thresholds (a fixed parameter grid),
    so the plan is an explode plus one small aggregation, no join.
    """
    idx = F.explode(F.sequence(F.lit(0), F.lit(PURITY_STEPS))).alias("i")
    ex = pur.select(purity_col, "size", idx).withColumn(
        "purity_threshold", F.lit(PURITY_START) + F.col("i") * F.lit(PURITY_STEP))
    return ex.groupBy("i", "purity_threshold").agg(
        (F.sum(F.when(F.col(purity_col) >= F.col("purity_threshold"), F.col("size")).otherwise(0))
         / F.sum("size")).alias("coverage")).drop("i")


def cluster_sizes(df: DataFrame, cluster: str) -> DataFrame:
    """Rows per cluster (PRO-5)."""
    return df.groupBy(cluster).agg(F.count(F.lit(1)).alias("size"))


def size_histogram(sizes: DataFrame, value: str = "size", bins: int = 15) -> DataFrame:
    """Equal-width histogram of ``value``; last bin closed (PRO-7)."""
    st = sizes.agg(F.min(value).cast("double").alias("lo"), F.max(value).cast("double").alias("hi"))
    lo = F.when(F.col("lo") == F.col("hi"), F.col("lo") - 0.5).otherwise(F.col("lo"))
    hi = F.when(F.col("lo") == F.col("hi"), F.col("hi") + 0.5).otherwise(F.col("hi"))
    st = st.select(lo.alias("lo"), hi.alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    # One-row statistics table joined on a constant key (a lookup, not a product).
    b = (sizes.select(F.col(value).cast("double").alias("x"), F.lit(0).alias("_k"))
         .join(F.broadcast(st.withColumn("_k", F.lit(0))), "_k")
         .withColumn("bin", F.least(F.floor((F.col("x") - F.col("lo")) * bins / (F.col("hi") - F.col("lo"))),
                                    F.lit(bins - 1)).cast("int")))
    counts = b.groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    grid = st.select(F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"), "lo", "hi")
    return (grid.join(counts, "bin", "left")
            .select("bin", (F.col("lo") + F.col("bin") * (F.col("hi") - F.col("lo")) / bins).alias("bin_lo"),
                    (F.col("lo") + (F.col("bin") + 1) * (F.col("hi") - F.col("lo")) / bins).alias("bin_hi"),
                    F.coalesce("n", F.lit(0)).cast("bigint").alias("n")))


def dominant_map(df: DataFrame, cluster: str, target: str) -> DataFrame:
    """Dominant class per cluster (PRO-8)."""
    return purity(crosstab_long(df, cluster, target), cluster, target).select(cluster, "dominant_type")


def classify_by_map(df: DataFrame, mapping: DataFrame, cluster: str, default: str = "unknown",
                    out: str = "y_pred") -> DataFrame:
    """Predict the cluster's dominant class, ``default`` for unmapped clusters (PRO-9).

    The mapping has one row per cluster; it is broadcast only after its row
    count is checked, otherwise the join is left to the planner.
    """
    m = mapping.withColumnRenamed("dominant_type", out)
    if m.count() <= MAP_BROADCAST_ROWS:
        m = F.broadcast(m)
    return (df.join(m, cluster, "left")
            .withColumn(out, F.coalesce(F.col(out), F.lit(default))))


def split_summary(df: DataFrame, split: str = "split", target: str = "type",
                  label: str = "label") -> DataFrame:
    """Rows, distinct classes and labels per split (PRO-10)."""
    return df.groupBy(split).agg(F.count(F.lit(1)).alias("n_rows"),
                                 F.countDistinct(target).alias("n_types"),
                                 F.countDistinct(label).alias("n_labels"))
