"""Score a stream of flows with fitted two-phase state.

All fitted state is static (featuriser lookup tables, one-hot fold map,
SVD loadings, centroids, dominant-type map), so scoring is a stateless
stream-static plan: lookup joins against the static tables, a per-batch
projection and nearest-centroid step, and a broadcast map lookup.  No
watermark or state store is involved; the sink's checkpoint goes under the
cluster's ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.operators import kmeans, profile
from flowlens.session import checkpoint_dir


def score(flows: DataFrame, embedder, centers, mapping: DataFrame | None = None,
          id_col: str = "flow_id") -> DataFrame:
    """(id, cluster, predicted type) for a batch or streaming flow DataFrame."""
    z = embedder.transform(flows, keep=(id_col,))
    out = kmeans.assign(z, "emb", centers, "cluster_kmeans30").drop("emb")
    if mapping is not None:
        out = profile.classify_by_map(out, mapping, "cluster_kmeans30", out="type_pred")
    return out


def start(spark: SparkSession, stream: DataFrame, embedder, centers, mapping=None, sink: str = "memory",
          name: str = "flow_scores", path: str | None = None):
    """Start the scoring query; returns the StreamingQuery."""
    scored = score(stream, embedder, centers, mapping)
    w = scored.writeStream.outputMode("append").option(
        "checkpointLocation", f"{checkpoint_dir(spark)}/stream-{name}-{uuid.uuid4().hex[:8]}")
    if sink == "memory":
        return w.format("memory").queryName(name).start()
    return w.format(sink).option("path", path).start()


def events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The driver's ``events`` table as a file stream, derived to flows."""
    from flowlens.sources.fixtures import flows_from_events
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    ev = (spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet")
          .option("maxFilesPerTrigger", 1).parquet(sf_dir))
    return flows_from_events(ev)
