"""Flow-shaped views derived from the driver's tables.

The reference reads one network-flow table that is not part of the
checkout.  ``flows`` derives an equivalent table from ``events`` with pure
column expressions (no shuffle, scan columns pruned), so every flow
operator can be exercised at any scale factor.  ``points2d`` and
``vectors`` are the point sets for the distance operators.

The DuckDB twins (``*_SQL``) are the same derivations as SQL text; the
oracle queries in ``__spark_entry__`` prepend them as CTEs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.sources.io import read_table

FLOW_COLUMNS = ["flow_id", "ts", "src_ip", "dst_ip", "src_port", "dst_port", "proto",
                "service", "duration", "src_bytes", "type", "label", "cluster", "split",
                "y_pred"]


def _mod(c: Column, m: int) -> Column:
    return c % F.lit(m)


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One flow per event: hosts, ports, protocol, service, targets.

    ``cluster``, ``split`` and ``y_pred`` are stand-ins used only by the
    report operators; the split / cluster operators compute their own.
    """
    return flows_from_events(read_table(spark, f"{sf_dir}/events.parquet"))


def flows_from_events(events: DataFrame) -> DataFrame:
    """Column-only derivation, so it also runs on a streaming ``events`` source."""
    e = events.select(
        "event_id", "ts", "user_id", "event_type", "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"))
    k3 = _mod(F.col("k"), 3)
    eid = F.col("event_id")
    t = e.select(
        eid.alias("flow_id"), "ts", "k",
        F.concat(F.lit("10.0.0."), _mod(F.col("user_id"), 50).cast("string")).alias("src_ip"),
        F.concat(F.lit("10.1.0."), _mod(F.col("k"), 20).cast("string")).alias("dst_ip"),
        F.when(_mod(eid, 97) == 0, F.lit(None)).otherwise(_mod(eid * 7919, 4096))
         .cast("double").alias("src_port"),
        F.when(k3 == 0, 53).when(k3 == 1, 443).otherwise(1024 + _mod(F.col("k") * 37, 2048))
         .cast("double").alias("dst_port"),
        F.when(k3 == 0, "udp").otherwise("tcp").alias("proto"),
        F.when(_mod(eid, 11) == 0, F.lit(None).cast("string"))
         .when(k3 == 0, "dns").when(k3 == 1, "ssl").otherwise("-").alias("service"),
        F.col("value").alias("duration"),
        F.floor(F.col("value") * 100).cast("bigint").alias("src_bytes"),
        F.when(_mod(eid, 5) == 0, F.col("event_type")).when(k3 == 0, "click")
         .when(k3 == 1, F.when(F.col("value") > 50, "error").otherwise("view"))
         .otherwise("signup").alias("type"),
    )
    fid = F.col("flow_id")
    return t.select(
        "flow_id", "ts", "src_ip", "dst_ip", "src_port", "dst_port", "proto", "service",
        "duration", "src_bytes", "type",
        F.when(F.col("type") == "view", 0).otherwise(1).alias("label"),
        F.when(_mod(fid, 50) == 7, -1).otherwise(_mod(F.col("k"), 12)).alias("cluster"),
        F.when(_mod(fid, 10) == 0, "test").when(_mod(fid, 10) == 1, "valid")
         .otherwise("train").alias("split"),
        F.when(_mod(fid, 13) == 0, "unknown").when(_mod(fid, 17) == 0, "click")
         .otherwise(F.col("type")).alias("y_pred"),
    )


def points2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2-D points (id, x, y) from customer: 25 stripes of account balances."""
    c = read_table(spark, f"{sf_dir}/customer.parquet")
    return c.select(F.col("c_custkey").alias("id"),
                    (F.col("c_acctbal") / 1000.0).alias("x"),
                    (F.col("c_nationkey") * 5.0).alias("y"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """64-dim vectors (id, vec array<double>, label) from embeddings."""
    v = read_table(spark, f"{sf_dir}/embeddings.parquet")
    return v.select(F.col("vec_id").alias("id"),
                    F.col("embedding").cast("array<double>").alias("vec"),
                    F.col("label"))


# ---- DuckDB twins (oracle side) -------------------------------------------------

FLOWS_SQL = """
select flow_id, ts, src_ip, dst_ip, src_port, dst_port, proto, service, duration, src_bytes, type,
  case when type = 'view' then 0 else 1 end as label,
  case when flow_id % 50 = 7 then -1 else k % 12 end as cluster,
  case flow_id % 10 when 0 then 'test' when 1 then 'valid' else 'train' end as split,
  case when flow_id % 13 = 0 then 'unknown' when flow_id % 17 = 0 then 'click' else type end as y_pred
from (
  select event_id as flow_id, ts, k,
    concat('10.0.0.', cast(user_id % 50 as varchar)) as src_ip,
    concat('10.1.0.', cast(k % 20 as varchar)) as dst_ip,
    cast(case when event_id % 97 = 0 then null else (event_id * 7919) % 4096 end as double) as src_port,
    cast(case when k % 3 = 0 then 53 when k % 3 = 1 then 443 else 1024 + (k * 37) % 2048 end as double) as dst_port,
    case when k % 3 = 0 then 'udp' else 'tcp' end as proto,
    case when event_id % 11 = 0 then null when k % 3 = 0 then 'dns' when k % 3 = 1 then 'ssl' else '-' end as service,
    value as duration, cast(floor(value * 100) as bigint) as src_bytes,
    case when event_id % 5 = 0 then event_type when k % 3 = 0 then 'click'
         when k % 3 = 1 then case when value > 50 then 'error' else 'view' end
         else 'signup' end as type
  from (select event_id, ts, user_id, event_type, value,
               cast(json_extract(props, '$.k') as integer) as k from events) e
) t
"""

POINTS2D_SQL = """
select c_custkey as id, c_acctbal / 1000.0 as x, c_nationkey * 5.0 as y from customer
"""

VECTORS_SQL = """
select vec_id as id, cast(embedding as double[]) as vec, label from embeddings
"""


def with_views(body: str, *extra: tuple[str, str], views: tuple[str, ...] = ("flows",)) -> str:
    """Build ``WITH flows AS (...), <extra...> <body>`` for the DuckDB oracle."""
    known = {"flows": FLOWS_SQL, "points2d": POINTS2D_SQL, "vectors": VECTORS_SQL}
    ctes = [f"{v} AS ({known[v]})" for v in views]
    ctes += [f"{name} AS ({sql})" for name, sql in extra]
    return "WITH " + ",\n".join(ctes) + "\n" + body
