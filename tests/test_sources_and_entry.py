"""Tables without a row id, CSV by its header, both phases end to end, and an entry that
survives a missing library."""

import subprocess
import sys

import pytest

from conftest import ROOT, SF_SMALL
from flowlens.plans import exploratory, two_phase
from flowlens.sources import io
from flowlens.sources.fixtures import flows


def bare_flows(spark):
    return flows(spark, SF_SMALL).drop("flow_id", "ts", "cluster", "split", "y_pred").limit(500)


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("flows")
    df = bare_flows(spark).cache()
    df.repartition(3).write.parquet(str(base / "flows.parquet"))
    df.repartition(2).write.option("header", True).csv(str(base / "flows.csv"))
    return str(base / "flows.parquet"), str(base / "flows.csv")


def test_row_ids_are_unique_and_stable(spark, files):
    for path in files:
        df = io.read_flows(spark, path)
        assert df.select("flow_id").distinct().count() == 500
    one, again = (io.read_flows(spark, files[0]).select("flow_id", "src_port", "duration") for _ in range(2))
    assert one.exceptAll(again).isEmpty()
    assert io.with_row_id(one, files[0]) is one


def test_csv_by_its_header(spark, files, tmp_path):
    csv, parquet = io.read_table(spark, files[1]), io.read_table(spark, files[0])
    kinds = dict(csv.dtypes)
    assert set(csv.columns) == set(parquet.columns)
    assert kinds["duration"] == "double" and kinds["src_bytes"] == "bigint" and kinds["proto"] == kinds["src_ip"] == "string"
    assert csv.select("duration", "src_bytes", "type").exceptAll(parquet.select("duration", "src_bytes", "type")).isEmpty()
    (tmp_path / "odd.csv").write_text("a,b,c,d,label,type\n1,1.5,x,,0,n\n-2,1e3,3,,1,m\n,.5,4,,1,m\n")
    odd = io.read_table(spark, str(tmp_path / "odd.csv"))
    assert dict(odd.dtypes) == {"a": "bigint", "b": "double", "c": "string", "d": "string", "label": "bigint", "type": "string"}
    assert sorted((r.a is None, r.a or 0, r.b) for r in odd.collect()) == [(False, -2, 1000.0), (False, 1, 1.5), (True, 0, 0.5)]


@pytest.mark.parametrize("which", [0, 1])
def test_two_phases_without_row_id(spark, files, tmp_path, which):
    two_phase.run(spark, files[which], str(tmp_path), k=4, n_init=2, num_trees=4, n_components=6)
    art = spark.read.parquet(str(tmp_path / "artifact.parquet"))
    assert art.count() == 500 and art.where("cluster_kmeans30 = -1").isEmpty()
    table = spark.read.option("header", True).csv(str(tmp_path / "metricas_globais_supervisionadas"))
    assert table.count() == 6


def test_exploratory_phase_without_row_id(spark, files, tmp_path):
    exploratory.run(spark, files[0], str(tmp_path), ks=(2, 4), n_init=2, min_samples=(5,), agg_ks=(3,), n_components=4, silhouette_n=100)
    best = spark.read.option("header", True).csv(str(tmp_path / "comparativo_melhores_configuracoes"))
    assert {r.algo for r in best.collect()} == {"KMeans", "DBSCAN", "Hierarchical"}
    assert spark.read.option("header", True).csv(str(tmp_path / "kmeans_curvas_por_k")).count() == 10


@pytest.mark.parametrize("module", ["xxhash", "sentencepiece", "flowlens.llm", "corpus_pipeline"])
def test_entry_survives_a_missing_module(module):
    code = (f"import sys; sys.modules[{module!r}] = None; sys.path.insert(0, {ROOT!r}); import __spark_entry__ as E; "
            "q, o = E.queries(), E.oracle_sql(); assert 'kmeans_fit' in q and 'dbscan' in o and set(o) <= set(q); "
            "print(len([n for n in q if n.startswith('op') or n == 'pipeline']))")
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    assert module == "sentencepiece" or out.stdout.strip() == "0"
