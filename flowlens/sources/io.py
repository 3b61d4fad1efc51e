"""Sources and sinks (SRC-1..6).

Parquet is the native format: column pruning and filter pushdown reach the
scan.  CSV is read with the schema given, or else with its header's names and one
pass that finds the numeric columns.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

REQUIRED_COLUMNS = ("label", "type")


def read_table(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """Read a table by file suffix (SRC-3); other suffixes raise ``ValueError``."""
    suffix = os.path.splitext(path.rstrip("/"))[1].lower()
    if suffix == ".parquet":
        reader = spark.read
        if schema is not None:
            reader = reader.schema(schema)
        return reader.parquet(path)
    if suffix == ".csv":
        if schema is None:
            schema = header_schema(spark, path)
        return spark.read.schema(schema).option("header", True).csv(path)
    raise ValueError(f"Unsupported format: {suffix}")


def header_schema(spark: SparkSession, path: str) -> StructType:
    """Names from a CSV's header; a column is a number if every value that is not empty
    reads as one, whole if all do, else text.  One pass over all columns."""
    text = spark.read.option("header", True).csv(path)
    checks = []
    for c in text.columns:
        v = F.col(f"`{c}`")
        whole = v.rlike(r"^\s*[+-]?\d{1,18}\s*$")
        number = whole | v.rlike(r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$")
        checks += [F.coalesce(F.bool_and(whole), F.lit(False)), F.coalesce(F.bool_and(number), F.lit(False))]
    found = text.agg(*[x.alias(f"c{k}") for k, x in enumerate(checks)]).first() if checks else ()
    kinds = [LongType() if found[2 * k] else DoubleType() if found[2 * k + 1] else StringType() for k in range(len(text.columns))]
    return StructType([StructField(c, t) for c, t in zip(text.columns, kinds)])


def with_row_id(df: DataFrame, path: str, id_col: str = "flow_id") -> DataFrame:
    """The table with a row id, its own if it has one.  A parquet row's is its file's place
    among the sorted files and its place in the file, so it is the same in every run; a
    CSV's rows are numbered as they are read and written once."""
    if id_col in df.columns:
        return df
    spark = df.sparkSession
    if os.path.splitext(path.rstrip("/"))[1].lower() != ".parquet":
        from flowlens.operators.store import materialize
        return materialize(df.withColumn(id_col, F.monotonically_increasing_id()), "numbered")
    names = df.columns
    placed = spark.read.parquet(path).select(*names, F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    files = sorted(r["_file"] for r in placed.select("_file").distinct().collect())
    numbers = spark.createDataFrame(list(enumerate(files)), "_no long, _file string")
    # one row per file
    return placed.join(F.broadcast(numbers), "_file").select(*names, (F.col("_no") * (1 << 40) + F.col("_row")).alias(id_col))


def read_flows(spark: SparkSession, path: str) -> DataFrame:
    """A flow table by suffix, with the columns that it needs and a row id."""
    return with_row_id(require_columns(read_table(spark, path)), path)


def require_columns(df: DataFrame, required=REQUIRED_COLUMNS) -> DataFrame:
    """Schema contract (SRC-4): checked at plan time, no job runs."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"The dataset needs columns {sorted(required)}; missing {missing}")
    return df


def write_parquet(df: DataFrame, path: str, partition_by: str | list[str] | None = None) -> None:
    """Enriched artefact sink (SRC-5); partitioned by split for pruning."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*([partition_by] if isinstance(partition_by, str) else partition_by))
    w.parquet(path)


def write_csv(df: DataFrame, path: str, single_file: bool = True) -> None:
    """Metric-table sink (SRC-6).  Metric tables are small aggregates, so one
    output file is the readable choice; row-scale tables keep their partitions."""
    out = df.coalesce(1) if single_file else df
    out.write.mode("overwrite").option("header", True).csv(path)
