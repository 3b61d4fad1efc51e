"""Sources, projection / cleaning and connectivity queries (SRC, PRJ, CON)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.types import (DoubleType, IntegerType, LongType, StringType, StructField,
                               StructType)

from flowlens.functions.columns import (LEAK_COLUMNS, composite_key, null_safe_key, round_d,
                                        to_double, well_known_flag)
from flowlens.operators import cleaning
from flowlens.operators.connectivity import (COUNT_COLUMNS, ConnectivityFeaturizer, host_stats,
                                             pair_counts, port_bucket, top_ports)
from flowlens.plans.registry import query
from flowlens.session import checkpoint_dir
from flowlens.sources.fixtures import flows, with_views
from flowlens.sources.io import read_table, write_csv, write_parquet

FIXTURE_EXTRA = ["cluster", "y_pred", "flow_id"]


def _scratch(spark, name: str) -> str:
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


@query("scan_flows", with_views("select * from flows"))
def scan_flows(spark, sf_dir):
    return flows(spark, sf_dir)


CSV_SCHEMA = StructType([
    StructField("flow_id", LongType()), StructField("src_ip", StringType()),
    StructField("dst_ip", StringType()), StructField("src_port", DoubleType()),
    StructField("dst_port", DoubleType()), StructField("proto", StringType()),
    StructField("service", StringType()), StructField("duration", DoubleType()),
    StructField("src_bytes", LongType()), StructField("type", StringType()),
    StructField("label", IntegerType())])
CSV_COLS = [f.name for f in CSV_SCHEMA.fields]


@query("scan_csv", with_views(f"select {', '.join(CSV_COLS)} from flows"))
def scan_csv(spark, sf_dir):
    path = _scratch(spark, "flows-csv") + ".csv"
    flows(spark, sf_dir).select(*CSV_COLS).write.option("header", True).csv(path)
    return read_table(spark, path, CSV_SCHEMA)


@query("write_artifact", with_views(
    "select flow_id, src_ip, dst_ip, type, label, split, cluster as cluster_kmeans30 from flows"))
def write_artifact(spark, sf_dir):
    path = _scratch(spark, "artifact") + ".parquet"
    df = flows(spark, sf_dir).select("flow_id", "src_ip", "dst_ip", "type", "label", "split",
                                     F.col("cluster").alias("cluster_kmeans30"))
    write_parquet(df, path, partition_by="split")
    back = spark.read.parquet(path)
    return back.select("flow_id", "src_ip", "dst_ip", "type", "label", "split", "cluster_kmeans30")


@query("features_clean", with_views(
    "select flow_id, ts, src_ip, dst_ip, src_port, dst_port, proto, service, duration, src_bytes "
    "from flows"))
def features_clean(spark, sf_dir):
    df = flows(spark, sf_dir)
    return cleaning.drop_leaks(df, extra=["cluster", "y_pred"])


_BAD_PORT = ("case when flow_id % 7 = 0 then 'bad' when src_port is null then null "
             "else cast(cast(src_port as bigint) as varchar) end")


@query("coerce_ports", with_views(
    f"select flow_id, try_cast(port_text as double) as src_port from "
    f"(select flow_id, {_BAD_PORT} as port_text from flows)"))
def coerce_ports(spark, sf_dir):
    df = flows(spark, sf_dir)
    text = (F.when(F.col("flow_id") % 7 == 0, F.lit("bad"))
            .when(F.col("src_port").isNull(), F.lit(None).cast("string"))
            .otherwise(F.col("src_port").cast("bigint").cast("string")))
    return df.select("flow_id", to_double(text).alias("src_port"))


@query("group_key", with_views(
    "select flow_id, concat_ws('->', coalesce(src_ip, 'NA'), coalesce(dst_ip, 'NA')) as pair, "
    "concat_ws('|', coalesce(src_ip, 'NA'), coalesce(dst_ip, 'NA'), coalesce(service, 'NA'), "
    "coalesce(proto, 'NA')) as grp from flows"))
def group_key(spark, sf_dir):
    df = flows(spark, sf_dir)
    return df.select("flow_id",
                     composite_key(df, ["src_ip", "dst_ip"], sep="->").alias("pair"),
                     composite_key(df, ["src_ip", "dst_ip", "service", "proto"]).alias("grp"))


@query("port_flags", with_views(
    "select flow_id, cast(coalesce(src_port < 1024, false) as tinyint) as src_port_wk, "
    "cast(coalesce(dst_port < 1024, false) as tinyint) as dst_port_wk from flows"))
def port_flags(spark, sf_dir):
    return flows(spark, sf_dir).select("flow_id", well_known_flag("src_port").alias("src_port_wk"),
                                       well_known_flag("dst_port").alias("dst_port_wk"))


@query("impute_constant", with_views(
    "select flow_id, coalesce(src_port, 0.0) as src_port, coalesce(service, 'missing') as service "
    "from flows"))
def impute_constant(spark, sf_dir):
    return cleaning.impute_constant(flows(spark, sf_dir).select("flow_id", "src_port", "service"),
                                    numeric=0.0, text="missing")


@query("impute_median", with_views(
    "select f.flow_id, round(coalesce(f.src_port, m.src_port), 9) as src_port, "
    "round(coalesce(f.duration, m.duration), 9) as duration from flows f, "
    "(select median(src_port) as src_port, median(duration) as duration from flows "
    " where split = 'train') m"))
def impute_median(spark, sf_dir):
    df = flows(spark, sf_dir)
    model = cleaning.MedianImputer(["src_port", "duration"]).fit(df.where(F.col("split") == "train"))
    out = model.transform(df.select("flow_id", "src_port", "duration"))
    return out.select("flow_id", round_d("src_port").alias("src_port"),
                      round_d("duration").alias("duration"))


@query("impute_mode", with_views(
    "select f.flow_id, coalesce(f.service, m.service) as service from flows f, "
    "(select service from (select service, count(*) as n from flows where split = 'train' "
    " and service is not null group by service) order by n desc, service asc limit 1) m"))
def impute_mode(spark, sf_dir):
    df = flows(spark, sf_dir)
    model = cleaning.ModeImputer(["service"]).fit(df.where(F.col("split") == "train"))
    return model.transform(df.select("flow_id", "service"))


@query("split_filter", with_views(
    "select flow_id, split, type from flows where split = 'test' "
    "union all select flow_id, 'fit' as split, type from flows where split in ('train', 'valid')"))
def split_filter(spark, sf_dir):
    df = flows(spark, sf_dir)
    test = cleaning.split_rows(df, "test").select("flow_id", "split", "type")
    fit = cleaning.split_rows(df, ["train", "valid"]).select("flow_id", F.lit("fit").alias("split"), "type")
    return test.unionByName(fit)


@query("exact_sample", with_views(
    "select flow_id, type from flows order by md5(concat(cast(flow_id as varchar), '42')), flow_id "
    "limit 500"))
def exact_sample(spark, sf_dir):
    return cleaning.exact_sample(flows(spark, sf_dir), 500, seed=42, key="flow_id").select("flow_id", "type")


# ---- connectivity (CON) -------------------------------------------------------------

@query("pair_counts", with_views(
    "select coalesce(src_ip, 'NA') as src_ip, coalesce(dst_ip, 'NA') as dst_ip, "
    "count(*) as pair_count from flows group by 1, 2"))
def q_pair_counts(spark, sf_dir):
    return pair_counts(flows(spark, sf_dir))


_DEG_SQL = with_views(
    "select 'src' as side, src_ip as host, cast(sum(n) as bigint) as n_flows, count(*) as n_peers "
    "from p group by src_ip union all "
    "select 'dst' as side, dst_ip as host, cast(sum(n) as bigint) as n_flows, count(*) as n_peers "
    "from p group by dst_ip",
    ("p", "select coalesce(src_ip, 'NA') as src_ip, coalesce(dst_ip, 'NA') as dst_ip, count(*) as n "
          "from flows group by 1, 2"))


def _degrees(spark, sf_dir):
    pairs = pair_counts(flows(spark, sf_dir))
    s = host_stats(pairs, "src").select(F.lit("src").alias("side"), F.col("src_ip").alias("host"),
                                        F.col("src_out_count").alias("n_flows"),
                                        F.col("src_unique_dst").alias("n_peers"))
    d = host_stats(pairs, "dst").select(F.lit("dst").alias("side"), F.col("dst_ip").alias("host"),
                                        F.col("dst_in_count").alias("n_flows"),
                                        F.col("dst_unique_src").alias("n_peers"))
    return s.unionByName(d)


@query("degree_counts", _DEG_SQL.replace(", count(*) as n_peers", ""))
def degree_counts(spark, sf_dir):
    return _degrees(spark, sf_dir).drop("n_peers")


@query("distinct_peers", _DEG_SQL.replace("cast(sum(n) as bigint) as n_flows, ", ""))
def distinct_peers(spark, sf_dir):
    return _degrees(spark, sf_dir).drop("n_flows")


_TOP_SQL = """
select side, port, n from (
  select side, port, n, row_number() over (partition by side order by n desc, port asc) as rk
  from (select 'src' as side, src_port as port, count(*) as n from flows where src_port is not null group by 2
        union all
        select 'dst' as side, dst_port as port, count(*) as n from flows where dst_port is not null group by 2))
where rk <= 20
"""


@query("top_ports", with_views(_TOP_SQL))
def q_top_ports(spark, sf_dir):
    df = flows(spark, sf_dir)
    return (top_ports(df, "src_port").select(F.lit("src").alias("side"), "port", "n")
            .unionByName(top_ports(df, "dst_port").select(F.lit("dst").alias("side"), "port", "n")))


@query("port_bucket", with_views(
    "select f.flow_id, "
    "coalesce(cast(cast(s.port as bigint) as varchar), 'other') as src_port_top, "
    "coalesce(cast(cast(d.port as bigint) as varchar), 'other') as dst_port_top from flows f "
    "left join (select port from top where side = 'src') s on f.src_port = s.port "
    "left join (select port from top where side = 'dst') d on f.dst_port = d.port",
    ("top", _TOP_SQL)))
def q_port_bucket(spark, sf_dir):
    df = flows(spark, sf_dir)
    ts = [r.port for r in top_ports(df, "src_port").collect()]
    td = [r.port for r in top_ports(df, "dst_port").collect()]
    return df.select("flow_id", port_bucket("src_port", ts).alias("src_port_top"),
                     port_bucket("dst_port", td).alias("dst_port_top"))


def _conn_sql(fit_where: str, apply_where: str) -> str:
    return with_views(
        f"""select f.flow_id,
          cast(coalesce(f.src_port < 1024, false) as tinyint) as src_port_wk,
          cast(coalesce(f.dst_port < 1024, false) as tinyint) as dst_port_wk,
          coalesce(cast(cast(ts_.port as bigint) as varchar), 'other') as src_port_top,
          coalesce(cast(cast(td_.port as bigint) as varchar), 'other') as dst_port_top,
          round(ln(1 + coalesce(p.n, 0)), 9) as pair_count,
          round(ln(1 + coalesce(s.n_out, 0)), 9) as src_out_count,
          round(ln(1 + coalesce(d.n_in, 0)), 9) as dst_in_count,
          round(ln(1 + coalesce(s.n_peers, 0)), 9) as src_unique_dst,
          round(ln(1 + coalesce(d.n_peers, 0)), 9) as dst_unique_src
        from (select * from flows where {apply_where}) f
        left join p on coalesce(f.src_ip, 'NA') = p.src_ip and coalesce(f.dst_ip, 'NA') = p.dst_ip
        left join (select src_ip, sum(n) as n_out, count(*) as n_peers from p group by 1) s
          on coalesce(f.src_ip, 'NA') = s.src_ip
        left join (select dst_ip, sum(n) as n_in, count(*) as n_peers from p group by 1) d
          on coalesce(f.dst_ip, 'NA') = d.dst_ip
        left join (select port from top where side = 'src') ts_ on f.src_port = ts_.port
        left join (select port from top where side = 'dst') td_ on f.dst_port = td_.port""",
        ("fit", f"select * from flows where {fit_where}"),
        ("p", "select coalesce(src_ip, 'NA') as src_ip, coalesce(dst_ip, 'NA') as dst_ip, "
              "count(*) as n from fit group by 1, 2"),
        ("top", _TOP_SQL.replace("from flows", "from fit")))


def _conn_spark(spark, sf_dir, fit_split=None, apply_split=None):
    df = flows(spark, sf_dir)
    fit_df = df if fit_split is None else df.where(F.col("split") == fit_split)
    app_df = df if apply_split is None else df.where(F.col("split") == apply_split)
    model = ConnectivityFeaturizer(topN=20).fit(fit_df)
    out = model.transform(app_df.select("flow_id", "src_ip", "dst_ip", "src_port", "dst_port"))
    return out.select("flow_id", "src_port_wk", "dst_port_wk", "src_port_top", "dst_port_top",
                      *[round_d(c).alias(c) for c in COUNT_COLUMNS])


@query("connectivity_features", _conn_sql("true", "true"))
def connectivity_features(spark, sf_dir):
    return _conn_spark(spark, sf_dir)


@query("featurize_train_apply", _conn_sql("split = 'train'", "split = 'test'"))
def featurize_train_apply(spark, sf_dir):
    return _conn_spark(spark, sf_dir, "train", "test")
