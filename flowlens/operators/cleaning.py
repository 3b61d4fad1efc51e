"""Cleaning and selection operators (PRJ-1..14)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.functions.columns import LEAK_COLUMNS
from flowlens.operators.store import value_ranks, values_at


def drop_leaks(df: DataFrame, extra=()) -> DataFrame:
    """Drop target / output columns when present (PRJ-1, PRJ-2)."""
    return df.drop(*LEAK_COLUMNS, *extra)


def impute_constant(df: DataFrame, numeric=0.0, text="missing") -> DataFrame:
    """Constant fill: numbers -> ``numeric``, strings -> ``text`` (PRJ-9)."""
    return df.fillna(numeric).fillna(text)


def split_rows(df: DataFrame, split, col: str = "split") -> DataFrame:
    """Rows of one split or a list of splits (PRJ-12); pruned at the scan when
    the artefact is partitioned by split."""
    if isinstance(split, str):
        return df.where(F.col(col) == split)
    return df.where(F.col(col).isin(list(split)))


def exact_sample(df: DataFrame, n: int, seed: int = 42, key: str = "flow_id") -> DataFrame:
    """Exactly ``min(n, rows)`` rows, uniform without replacement, repeatable (PRJ-14).

    Order by a keyed hash of the row id and keep the first ``n``: Spark plans
    it as TakeOrderedAndProject (per-partition top-n, then merge), so only
    ``n`` rows per partition move.  The same md5 text runs on other engines.
    """
    h = F.md5(F.concat(F.col(key).cast("string"), F.lit(str(seed))))
    return df.orderBy(h, F.col(key)).limit(int(n))


def bounded_sample(df: DataFrame, n: int, seed: int = 42, key: str = "flow_id") -> list:
    """The rows of ``exact_sample`` on the driver.  Where there are many rows, only those
    whose hash begins low enough are ordered, so a task sends its share of about ``n``
    rows and not ``n`` rows of its own."""
    total = df.count()
    if total > 4 * n:
        # the first 8 hex digits of the sampling hash, below a bound that n rows pass all but surely
        part = (n + 8 * math.sqrt(n) + 8) / total
        h = F.md5(F.concat(F.col(key).cast("string"), F.lit(str(seed))))
        few = exact_sample(df.where(F.conv(F.substring(h, 1, 8), 16, 10).cast("long") < int(part * 2 ** 32)), n, seed, key).collect()
        if len(few) == n:
            return few
    return exact_sample(df, n, seed, key).collect()


def exact_median(df: DataFrame, col: str, accuracy: int = 10000) -> float | None:
    """Exact median with linear midpoint, without sorting the whole column.

    1. ``percentile_approx`` brackets the middle ranks (rank error <= n/accuracy).
    2. One pass counts rows below the bracket and rows inside it.
    3. A bracket of one value is the median.  Otherwise the values inside it are
       counted by value, and the two middle ranks are read from the cumulated
       counts, so a value that many rows share is one row.  If the bracket
       misses, the whole non-null column is used instead (still exact).
    """
    x = F.col(col).cast("double")
    vals = df.select(x.alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    eps = 2.0 / accuracy
    stats = vals.agg(F.count(F.lit(1)).alias("n"),
                     F.percentile_approx("v", [max(0.0, 0.5 - eps), min(1.0, 0.5 + eps)],
                                         accuracy).alias("b")).first()
    n = stats["n"]
    if not n:
        return None
    lo, hi = stats["b"]
    k = (n - 1) * 0.5
    r0, r1 = math.floor(k), math.ceil(k)
    cnt = vals.agg(F.sum(F.when(F.col("v") < lo, 1).otherwise(0)).alias("below"),
                   F.sum(F.when((F.col("v") >= lo) & (F.col("v") <= hi), 1).otherwise(0)).alias("inside")
                   ).first()
    below, inside = cnt["below"] or 0, cnt["inside"] or 0
    if below <= r0 and r1 < below + inside:
        if lo == hi:
            return lo
        sub, off = vals.where((F.col("v") >= lo) & (F.col("v") <= hi)), below
    else:
        sub, off = vals, 0
    found = values_at(value_ranks(sub, "v")[0], (r0 - off, r1 - off))
    a, b = found[r0 - off], found[r1 - off]
    return a + (b - a) * (k - r0)


class MedianImputer:
    """Median fill learned on one DataFrame, applied to others (PRJ-10).

    ``ml.feature.Imputer`` is not used: its median is approximate and for
    {1, 2, 3, 4} returns 2.0 instead of the midpoint 2.5.
    """

    def __init__(self, cols):
        self.cols = list(cols)
        self.values: dict[str, float | None] = {}

    def fit(self, df: DataFrame) -> "MedianImputer":
        self.values = {c: exact_median(df, c) for c in self.cols}
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(v).cast("double"))
                               for c, v in self.values.items()})


class ModeImputer:
    """Most-frequent fill, lowest value wins ties (PRJ-11).

    All columns are unpivoted into one (column, value) count, so the table is
    shuffled once with map-side partial counts; the winner per column is a
    grouped ``min_by`` aggregate (also partial), so no task holds a column's
    distinct values.
    """

    def __init__(self, cols):
        self.cols = list(cols)
        self.values: dict[str, str | None] = {}

    def fit(self, df: DataFrame) -> "ModeImputer":
        long = df.select(F.explode(F.array(*[
            F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in self.cols
        ])).alias("kv")).select("kv.c", "kv.v").where(F.col("v").isNotNull())
        counts = long.groupBy("c", "v").agg(F.count(F.lit(1)).alias("n"))
        top = counts.groupBy("c").agg(F.min_by("v", F.struct(-F.col("n"), F.col("v"))).alias("v")).collect()
        self.values = {c: None for c in self.cols}
        self.values.update({r["c"]: r["v"] for r in top})
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in self.values.items()})
