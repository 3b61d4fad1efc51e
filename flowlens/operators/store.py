"""Written tables in the shared checkpoint folder, used to cut lineage in
iterative operators (a lost executor recomputes one round, not all)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlens.session import checkpoint_dir


class TableStore:
    def __init__(self, spark, prefix: str):
        self.spark = spark
        self.base = f"{checkpoint_dir(spark)}/{prefix}-{uuid.uuid4().hex[:12]}"
        self.n = 0

    def save(self, df: DataFrame, name: str | None = None, mode: str = "overwrite") -> DataFrame:
        self.n += 1
        path = f"{self.base}/{name or f't{self.n}'}"
        df.write.mode(mode).parquet(path)
        return self.spark.read.parquet(path)


def global_rank(df: DataFrame, order_cols, out: str = "rank", partitions: int | None = None) -> DataFrame:
    """1-based rank by ``order_cols`` (a total order) without a single-partition
    window: range-partition, rank inside each partition, write, and add
    per-partition offsets read from the written table."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    s = df.repartitionByRange(n, *order_cols).withColumn("_pid", F.spark_partition_id())
    local = materialize(s.withColumn("_lr", F.row_number().over(Window.partitionBy("_pid").orderBy(*order_cols))), "rank")
    counts = local.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    # one row per partition: the running offset window is over a tiny table
    offs = counts.withColumn("_off", F.coalesce(F.sum("_n").over(
        Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return (local.join(F.broadcast(offs.select("_pid", "_off")), "_pid")
            .withColumn(out, F.col("_lr") + F.col("_off")).drop("_pid", "_lr", "_off"))


def value_ranks(df: DataFrame, col: str, partitions: int | None = None) -> tuple[DataFrame, int]:
    """(value, first, last): the 0-based ranks that each distinct value of ``col`` takes
    in order, and the number of values; nulls don't count.  Equal values are one counted
    row, so no task or driver gets more of a value that many rows share."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("_n"))
    s = counts.repartitionByRange(n, "value").withColumn("_pid", F.spark_partition_id())
    local = materialize(s.withColumn("_to", F.sum("_n").over(Window.partitionBy("_pid").orderBy("value"))), "ranks")
    # one row per partition
    sums = {r["_pid"]: r["s"] for r in local.groupBy("_pid").agg(F.sum("_n").alias("s")).collect()}
    offsets, total = [], 0
    for pid in sorted(sums):
        offsets.append((pid, total))
        total += sums[pid]
    offs = df.sparkSession.createDataFrame(offsets, "_pid int, _off long")
    last = F.col("_off") + F.col("_to") - 1
    return local.join(F.broadcast(offs), "_pid").select("value", (last - F.col("_n") + 1).alias("first"), last.alias("last")), total


def values_at(ranked: DataFrame, ranks) -> dict[int, float]:
    """The values at a few 0-based ranks of ``value_ranks``."""
    ranks = sorted(set(ranks))
    if not ranks:
        return {}
    held = F.filter(F.array(*[F.lit(r) for r in ranks]), lambda r: (r >= F.col("first")) & (r <= F.col("last")))
    rows = ranked.select("value", F.explode(held).alias("r")).collect()
    return {r["r"]: r["value"] for r in rows}


def materialize(df: DataFrame, prefix: str = "tmp") -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back.

    Used for intermediates that many later jobs read (features, design
    matrices, embeddings): each job then plans a parquet scan instead of the
    whole upstream lineage, which keeps plans, driver memory and recomputation
    small, and a lost executor does not recompute the upstream."""
    return TableStore(df.sparkSession, prefix).save(df)


def spread(df: DataFrame, rows: int, row_bytes: int, small: int = 32 << 20) -> DataFrame:
    """``df`` dealt to every core, where it is too small for its files to be; larger
    tables have partitions enough and stay as they are.  For passes that compute much."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if rows * row_bytes < cores * small else df
