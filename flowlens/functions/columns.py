"""Scalar column expressions (PRJ-*).  All JVM-side, codegen-friendly."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType, StringType

# Columns the reference never uses as features (targets, split
# and cluster outputs, cluster annotations), as one union list.
LEAK_COLUMNS = ["label", "type", "split", "cluster_kmeans30", "cluster_name",
                "purity_valid", "purity_test"]

NA = "NA"


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_double(c) -> Column:
    """Text or number -> double; unparsable -> null (PRJ-3)."""
    return col_(c).try_cast("double")


def null_safe_key(c) -> Column:
    """Cast to string; null -> 'NA' (PRJ-5)."""
    return F.coalesce(col_(c).cast("string"), F.lit(NA))


def composite_key(df: DataFrame, cols, sep: str = "|", id_col: str = "flow_id") -> Column:
    """``a|b|...`` over the columns present (PRJ-6); none present -> row id."""
    present = [c for c in cols if c in df.columns]
    if not present:
        return col_(id_col).cast("string")
    return F.concat_ws(sep, *[null_safe_key(c) for c in present])


def well_known_flag(c, limit: int = 1024) -> Column:
    """``port < 1024`` as tinyint; null port -> 0 (PRJ-7)."""
    return F.coalesce(col_(c) < F.lit(limit), F.lit(False)).cast("tinyint")


def split_columns(df: DataFrame, exclude=()) -> tuple[list[str], list[str]]:
    """Numeric/boolean vs string feature columns from the schema (PRJ-4).

    Other types (timestamps, arrays) are not features, as in the reference.
    """
    num, cat = [], []
    for f in df.schema.fields:
        if f.name in exclude:
            continue
        if isinstance(f.dataType, (NumericType, BooleanType)):
            num.append(f.name)
        elif isinstance(f.dataType, StringType):
            cat.append(f.name)
    return num, cat


def round_d(c, digits: int = 9) -> Column:
    return F.round(col_(c).cast("double"), digits)


# log(n!) is exact through n = 20 via factorial(); above that a
# Stirling series with four correction terms is accurate to ~1e-15 relative.
_LN_2PI_HALF = 0.5 * math.log(2 * math.pi)


def log_factorial(n) -> Column:
    """ln(n!) for integer n >= 0 without a gamma function in Spark SQL."""
    n = col_(n).cast("double")
    small = F.log(F.factorial(F.least(n, F.lit(20.0)).cast("int")).cast("double"))
    x = n + F.lit(1.0)  # ln Gamma(x)
    stirling = ((x - 0.5) * F.log(x) - x + F.lit(_LN_2PI_HALF)
                + F.lit(1.0 / 12) / x - F.lit(1.0 / 360) / F.pow(x, 3)
                + F.lit(1.0 / 1260) / F.pow(x, 5) - F.lit(1.0 / 1680) / F.pow(x, 7))
    return F.when(n <= 20, small).otherwise(stirling)
