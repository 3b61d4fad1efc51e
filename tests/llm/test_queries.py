"""The registered queries: against their SQL, and the pipeline's stages."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), "tools"))

import __spark_entry__ as E  # noqa: E402
import corpus_pipeline  # noqa: E402
from check_oracle import duck, rows_of  # noqa: E402
from conftest import SF_SMALL  # noqa: E402
from flowlens.llm import queries  # noqa: E402


def test_one_query_for_each_operator():
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES)
    assert numbers == list(range(1, 14))
    assert set(queries.QUERIES) | {"pipeline"} <= set(E.queries())


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_matches_sql(spark, name):
    df = queries.QUERIES[name](spark, SF_SMALL)
    sc, sr = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = duck(SF_SMALL).execute(queries.ORACLE[name])
    dc, dr = rows_of([d[0] for d in cur.description], cur.fetchall())
    assert sc == dc and sr == dr


def test_pipeline_stages(spark, tmp_path):
    source = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    docs, kept = source, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF_SMALL).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        kept.append(docs)
    assert [sorted(d.columns) for d in kept[:3]] == [sorted(source.columns)] * 3
    quality, near, clean, packed = kept
    assert near.select("doc_id").subtract(quality.select("doc_id")).count() == 0
    assert clean.count() == near.count()
    assert clean.where("text rlike 'AKIA[A-Z0-9]{14,}|[0-9a-f]{16,}'").count() == 0
    assert packed.select("doc_id").distinct().count() == clean.select("doc_id").distinct().count()
    from flowlens.llm import jaccard
    assert jaccard.join_near(near).where("n_links > 0").count() == 0
