"""Connected components on an edge DataFrame (CLU-10).

Hooking on a contracting graph, all DataFrame operations:
1. Edges are stored once as (a, b) with a < b.
2. Hook: every endpoint b takes as parent its smallest neighbour a
   (``groupBy(b).min(a)``; map-side partial mins absorb hub vertices).
   Parents are always smaller, so the parent links form a forest.
3. Jump: parents are followed three steps in one plan, until every parent is
   a root, i.e. has no parent itself; the table that holds the new parents
   says whether any has.
4. Contract: edges become (p(a), p(b)), self loops and duplicates dropped.
Only local minima survive a round, so the edge table shrinks geometrically;
the loop ends when no edge is left.  Labels are composed once, at the end,
from the rounds' parent tables.

Each round's tables are written to the cluster's shared
``spark.checkpoint.dir`` and read back: lineage stays one round deep and a
lost executor only recomputes the current round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.operators.neighbors import keys_once, knn
from flowlens.operators.store import TableStore, materialize

# The reference's neighbour counts.
CONNECT_KS = tuple(range(30, 401, 20))
FIRST = 30                  #: neighbours computed at once for the first ks: the search costs the same as for one
AHEAD, LEAST_AHEAD = 4, 64  #: neighbours computed beyond a k that does not connect the points: times that k, and at least


def _roots(hook: DataFrame, store: TableStore) -> DataFrame:
    """(v, p): each vertex's root; roots themselves have no row in ``hook``."""
    while True:
        one, two, three = (hook.select(F.col("v").alias(f"v{k}"), F.col("p").alias(f"p{k}")) for k in (1, 2, 3))
        up = hook.join(one, F.col("p") == F.col("v1"), "left").select("v", F.coalesce("p1", "p").alias("p"))
        up = up.join(two, F.col("p") == F.col("v2"), "left").select("v", F.coalesce("p2", "p").alias("p"))
        up = up.join(three, F.col("p") == F.col("v3"), "left").select("v", "p", F.col("v3").isNotNull().alias("more"))
        up = store.save(up)
        hook = up.drop("more")
        if up.where("more").isEmpty():
            return hook


def connected_components(edges: DataFrame, vertices: DataFrame | None = None, src: str = "src",
                         dst: str = "dst", vid: str = "id") -> DataFrame:
    """(id, component) where component = min vertex id of its component."""
    store = TableStore(edges.sparkSession, "cc")
    e = edges.select(F.col(src).alias("a0"), F.col(dst).alias("b0")).where(F.col("a0") != F.col("b0"))
    e = store.save(e.select(F.least("a0", "b0").alias("a"), F.greatest("a0", "b0").alias("b")).distinct())
    if vertices is None:
        vertices = e.select(F.col("a").alias(vid)).union(e.select(F.col("b").alias(vid)))
    labels = vertices.select(F.col(vid).alias("v")).distinct().withColumn("l", F.col("v"))
    while not e.isEmpty():
        p = _roots(store.save(e.groupBy(F.col("b").alias("v")).agg(F.min("a").alias("p"))), store)
        pa = p.select(F.col("v").alias("a"), F.col("p").alias("pa"))
        pb = p.select(F.col("v").alias("b"), F.col("p").alias("pb"))
        a, b = F.coalesce("pa", "a"), F.col("pb")  # every b has a parent
        e = store.save(e.join(pb, "b").join(pa, "a", "left").select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
                       .where("a <> b").distinct())
        labels = (labels.join(p.select(F.col("v").alias("l"), F.col("p").alias("np")), "l", "left")
                  .select("v", F.coalesce("np", "l").alias("l")))
    return store.save(labels.select(F.col("v").alias(vid), F.col("l").alias("component")))


def count_components(labels: DataFrame) -> int:
    return labels.select("component").distinct().count()


def connect_until_one(points: DataFrame, col: str, key: str, ks=CONNECT_KS) -> tuple[list[tuple[int, int]], DataFrame]:
    """Neighbour graphs of growing k until one has a single component (CLU-11).

    Returns (k, components) of every k tried and the last graph's edges (i, j, dist,
    rank); if no k connects the points, the last k's, as its components tell.  The
    neighbours are computed for the first ks up to 30 (the first k alone where keys repeat, as
    their neighbours depend on the k of the search) and, while those do not connect the points,
    once more at a k some four times as large, so that few more of them are found than the
    graph needs; each further k only adds its new edges between the components so far."""
    ks = sorted(ks)
    rows, labels, held = [], None, 0
    first = FIRST if ks[0] < FIRST and keys_once(points, key) else 0
    for last, k in zip([0, *ks], ks):
        if k > held:
            held = max(x for x in ks if x <= (max(k, AHEAD * last, LEAST_AHEAD) if last else max(k, first)))
            nn = materialize(knn(points, col, key, held, include_self=False), "knn")
        if labels is None:
            labels = connected_components(nn.where(F.col("rank") <= k), points.select(F.col(key).alias("id")), "i", "j", "id")
        else:
            a = labels.select(F.col("id").alias("i"), F.col("component").alias("a"))
            b = labels.select(F.col("id").alias("j"), F.col("component").alias("b"))
            new = nn.where((F.col("rank") > last) & (F.col("rank") <= k)).join(a, "i").join(b, "j").where("a <> b")
            merged = connected_components(new.select("a", "b"), labels.select(F.col("component").alias("was")), "a", "b", "was")
            labels = materialize(labels.join(merged.withColumnRenamed("component", "now"), F.col("component") == F.col("was"))
                                 .select("id", F.col("now").alias("component")), "connect")
        rows.append((k, count_components(labels)))
        if rows[-1][1] <= 1:
            break
    return rows, nn.where(F.col("rank") <= rows[-1][0])
