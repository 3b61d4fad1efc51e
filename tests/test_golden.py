"""Golden vectors: published count tables -> published scores."""

import pytest
from pyspark.sql import functions as F

from golden import (CLASS_REPORT_TYPE_TEST, CLUSTER_TYPE_COUNTS, CONFUSION_TYPE_TEST, COVERAGE,
                    EXTERNAL_TEST_TYPE, GLOBAL_TYPE_TEST, PURITY, TYPES)
from flowlens.operators import external, profile, reports


def _ct(spark):
    rows = [(c, t, n) for c, ns in CLUSTER_TYPE_COUNTS.items() for t, n in zip(TYPES, ns) if n]
    return spark.createDataFrame(rows, "cluster int, type string, n bigint")


def test_external_scores_match_published(spark):
    ct = _ct(spark).select(F.col("type").alias("u"), F.col("cluster").cast("string").alias("v"), "n")
    r = external.scores_from_contingency(ct).first()
    for k, v in EXTERNAL_TEST_TYPE.items():
        assert r[k] == pytest.approx(v, abs=1e-12), k


def test_external_scores_invariant_to_cluster_relabeling(spark):
    ct = _ct(spark).select(F.col("type").alias("u"), (F.col("cluster") * 7 + 3).cast("string").alias("v"), "n")
    r = external.scores_from_contingency(ct).first()
    assert r["AMI"] == pytest.approx(EXTERNAL_TEST_TYPE["AMI"], abs=1e-12)


def test_purity_and_coverage_match_published(spark):
    pur = {r["cluster"]: r for r in profile.purity(_ct(spark), "cluster", "type").collect()}
    for c, (p, size, dom) in PURITY.items():
        assert pur[c]["purity_type"] == pytest.approx(p, abs=1e-15)
        assert pur[c]["size"] == size and pur[c]["dominant_type"] == dom
    cov = {round(r["purity_threshold"], 2): r["coverage"]
           for r in profile.purity_coverage(profile.purity(_ct(spark), "cluster", "type")).collect()}
    assert len(cov) == 51
    for t, v in COVERAGE.items():
        assert cov[t] == pytest.approx(v, abs=5e-5)


def test_reports_match_published(spark):
    rows = [(TYPES[i], TYPES[j], n) for i, r in enumerate(CONFUSION_TYPE_TEST) for j, n in enumerate(r) if n]
    conf = spark.createDataFrame(rows, "y string, p string, n bigint")
    g = reports.global_metrics(conf).first()
    for k, v in GLOBAL_TYPE_TEST.items():
        assert g[k] == pytest.approx(v, abs=1e-12), k
    rep = {r["class"]: r for r in reports.class_report(conf).collect()}
    for c, (p, rc, f1) in CLASS_REPORT_TYPE_TEST.items():
        assert rep[c]["precision"] == pytest.approx(p, abs=1e-12)
        assert rep[c]["recall"] == pytest.approx(rc, abs=1e-12)
        assert rep[c]["f1_score"] == pytest.approx(f1, abs=1e-12)
    assert rep["accuracy"]["support"] == pytest.approx(GLOBAL_TYPE_TEST["accuracy"])


def test_predicted_only_class_rules(spark):
    # 'u' is predicted but has no support: counts in macro F1, not in balanced accuracy.
    conf = spark.createDataFrame([("a", "a", 3), ("a", "u", 1), ("b", "b", 2), ("b", "a", 2)],
                                 "y string, p string, n bigint")
    g = reports.global_metrics(conf).first()
    assert g["balanced_accuracy"] == pytest.approx((3 / 4 + 2 / 4) / 2)
    f1a = 2 * 3 / (4 + 5)
    f1b = 2 * 2 / (4 + 2)
    assert g["macroF1"] == pytest.approx((f1a + f1b + 0.0) / 3)


def test_identical_partitions_score_one(spark):
    ct = spark.createDataFrame([("x", "1", 5), ("y", "2", 7), ("z", "3", 1)], "u string, v string, n bigint")
    r = external.scores_from_contingency(ct).first()
    assert r["ARI"] == pytest.approx(1.0) and r["AMI"] == pytest.approx(1.0) and r["V"] == pytest.approx(1.0)


def test_single_cluster_edge_rules(spark):
    ct = spark.createDataFrame([("x", "1", 5), ("y", "1", 7)], "u string, v string, n bigint")
    r = external.scores_from_contingency(ct).first()
    assert r["ARI"] == pytest.approx(0.0) and r["V"] == pytest.approx(0.0) and r["AMI"] == pytest.approx(0.0)
    one = spark.createDataFrame([("x", "1", 5)], "u string, v string, n bigint")
    r = external.scores_from_contingency(one).first()
    assert r["ARI"] == 1.0 and r["AMI"] == 1.0 and r["V"] == 1.0
