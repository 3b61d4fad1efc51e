"""flowlens: two-phase network-flow analytics on Spark.

Unsupervised phase: featurise flows, embed, cluster, score and profile the
clusters.  Supervised phase: group-disjoint splits, classifiers, reports.
Every row-scale step is a DataFrame plan or a Spark ML estimator; only
provably small state (centroids, contingency tables, loadings) reaches the
driver.
"""

from flowlens.session import get_spark, checkpoint_dir  # noqa: F401

__version__ = "0.1.0"
