"""N-gram Jaccard join with Bayesian candidate pruning.

Documents are sets of hashed five-word shingles (a text of one to four words is
one shingle).  Links join documents of Jaccard similarity at least ``threshold``.

1. Equal sets are one node; copies are a count, never pairs.
2. Candidates: MinHash bands; nodes that share a band's key are tied to the key's
   smallest node (a star, linear in the group's size).  Connected stars form
   candidate groups: every pair with a common key lies inside one group.
3. A group is dealt into blocks, bounded in nodes and shingles.  Each pair of
   blocks is one unit of work.  In a unit, a pair's MinHash values are compared
   ``STEP`` at a time; with m of n equal, the posterior probability (uniform
   prior) that the similarity reaches the threshold is the binomial
   P(X <= m), X ~ B(n + 1, threshold).  Pairs below ``TOLERANCE`` are dropped;
   the rest are verified exactly, on bitmaps over the unit's shared shingles.
4. A unit gives each node's number of links and a spanning forest of them, so its
   output is linear in its nodes.  Connected forests give the classes.

With 32 bands of 5 values a pair at the threshold itself is missed with
probability 3e-6, pairs above it with less.

Cases: a null text or one without words has no shingles, no links and a class of
its own; texts may be of any length; repeated rows are copies of one node; rows
with null ids take part, and a class's id is its smallest id that is not null;
ids may occur with several texts; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from hashlib import blake2b
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.pieces import UnitCache, sliced
from flowlens.operators.components import connected_components
from flowlens.operators.store import materialize

SHINGLE = 5
BANDS, ROWS = 32, 5
STEP, TOLERANCE = 16, 1e-7
BLOCK_NODES, BLOCK_SHINGLES = 512, 1_500_000
WORDS = re.compile(r"[^ \t-\r]+")
_RNG = np.random.default_rng(20)
MULTIPLY = _RNG.integers(0, 1 << 63, BANDS * ROWS, np.uint64) << np.uint64(1) | np.uint64(1)
ADD = _RNG.integers(0, 1 << 63, BANDS * ROWS, np.uint64)
POSITION = _RNG.integers(0, 1 << 63, SHINGLE, np.uint64) << np.uint64(1) | np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_cache() -> UnitCache:
    return UnitCache(lambda words: [xxhash.xxh3_64_intdigest(w) for w in words])


def shingle_sets(texts: list[str], cache: UnitCache) -> list[np.ndarray]:
    """Each text's shingles: ascending, distinct 64-bit hashes."""
    words = [WORDS.findall(t) for t in texts]
    hashes = np.array(cache.values([w for one in words for w in one]), np.uint64)
    out, at = [], 0
    for one in words:
        h = hashes[at:at + len(one)]
        at += len(one)
        n = min(SHINGLE, len(h))
        size = len(h) - n + 1 if n else 0
        total = np.full(size, n, np.uint64)
        for k in range(n):
            total += mix(h[k:k + size] * POSITION[k])
        out.append(np.unique(mix(total)))
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    """MinHash values of a set."""
    best = np.full(len(MULTIPLY), 0xFFFFFFFF, np.uint64)
    for at in range(0, len(shingles), 1024):
        part = shingles[None, at:at + 1024] * MULTIPLY[:, None] + ADD[:, None]
        best = np.minimum(best, part.min(axis=1) >> np.uint64(32))
    return best.astype("<u4")


def band_keys(sig: np.ndarray) -> np.ndarray:
    rows = sig.reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, k])
    return key.view(np.int64)


def least_matches(threshold: float, tolerance: float) -> dict[int, int]:
    """n -> the fewest equal values of n at which a pair stays."""
    out = {}
    for n in range(STEP, BANDS * ROWS + 1, STEP):
        below, m = 0.0, 0
        while m <= n:
            below += comb(n + 1, m) * threshold ** m * (1 - threshold) ** (n + 1 - m)
            if below >= tolerance:
                break
            m += 1
        out[n] = m
    return out


def signatures(documents: DataFrame) -> DataFrame:
    """(id, digest, fp, n, sig, bands); fp names the set, null without shingles; digest is
    the text's, so (id, digest) names a row up to copies of it."""
    kind = documents.schema["id"].dataType.simpleString()

    def run(batches):
        cache = word_cache()
        for batch in batches:
            ids, at = batch.column("id"), 0
            for part in sliced(batch.column("text").to_pylist()):
                sets = shingle_sets(part, cache)
                sigs = [signature(s) for s in sets]
                yield pa.RecordBatch.from_arrays([
                    ids.slice(at, len(part)), batch.column("digest").slice(at, len(part)),
                    pa.array([set_name(s) for s in sets], pa.string()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([s.tobytes() for s in sigs], pa.binary()),
                    pa.array([band_keys(s).tolist() if len(x) else [] for s, x in zip(sigs, sets)], pa.list_(pa.int64())),
                ], ["id", "digest", "fp", "n", "sig", "bands"])
                at += len(part)

    return documents.mapInArrow(run, f"id {kind}, digest string, fp string, n long, sig binary, bands array<bigint>")


def set_name(shingles: np.ndarray) -> str | None:
    return blake2b(shingles.tobytes(), digest_size=16).hexdigest() if len(shingles) else None


def sets_of(documents: DataFrame) -> DataFrame:
    """(fp, shingles binary) of the sets of these documents whose ``want`` names them."""
    def run(batches):
        cache = word_cache()
        for batch in batches:
            wants, at = batch.column("want").to_pylist(), 0
            for part in sliced(batch.column("text").to_pylist()):
                rows = [(w, s.tobytes()) for w, s in zip(wants[at:at + len(part)], shingle_sets(part, cache))
                        if set_name(s) == w]
                at += len(part)
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()),
                                                  pa.array([r[1] for r in rows], pa.binary())], ["fp", "shingles"])

    return documents.select("want", "text").mapInArrow(run, "fp string, shingles binary")


def compare(left: pd.DataFrame, right: pd.DataFrame, same: bool, least: dict[int, int], num: int, den: int):
    """Yields (row of left, rows of right) of the linked pairs, each pair once.
    A pair is linked if intersection / union >= num / den."""
    sig_l, sig_r = (np.stack([np.frombuffer(s, "<u4") for s in p["sig"]]) for p in (left, right))
    sets_l = [np.frombuffer(s, np.uint64) for s in left["shingles"]]
    sets_r = sets_l if same else [np.frombuffer(s, np.uint64) for s in right["shingles"]]
    size_l, size_r = np.array([len(s) for s in sets_l]), np.array([len(s) for s in sets_r])
    values, counts = np.unique(np.concatenate(sets_l if same else sets_l + sets_r), return_counts=True)
    shared = values[counts > 1]
    words = len(shared) // 64 + 1

    def bits(one):
        at = np.searchsorted(shared, one)
        at = at[(at < len(shared)) & (shared[np.minimum(at, len(shared) - 1)] == one)] if len(shared) else at[:0]
        row = np.zeros(words, np.uint64)
        np.bitwise_or.at(row, at // 64, np.uint64(1) << (at % 64).astype(np.uint64))
        return row

    bits_r: dict[int, np.ndarray] = {}

    def bits_of(rows):
        for k in rows:
            if k not in bits_r:
                bits_r[k] = bits(sets_r[k])
        return [bits_r[k] for k in rows]

    for i in range(len(left)):
        near = np.arange(i + 1 if same else 0, len(right))
        equal = np.zeros(len(near), np.int64)
        for n, m in least.items():
            if not len(near):
                break
            equal += (sig_r[near, n - STEP:n] == sig_l[i, n - STEP:n]).sum(axis=1)
            stay = equal >= m
            near, equal = near[stay], equal[stay]
        if not len(near):
            continue
        own, linked = bits(sets_l[i]), []
        for at in range(0, len(near), 256):
            part = near[at:at + 256]
            both = np.bitwise_count(np.stack(bits_of(part.tolist())) & own).sum(axis=1, dtype=np.int64)
            linked.append(part[(num + den) * both >= num * (size_l[i] + size_r[part])])
        linked = np.concatenate(linked)
        if len(linked):
            yield i, linked


def links(groups: DataFrame, num: int, den: int) -> DataFrame:
    """(node, texts, docs, root) of every linked node of a unit, from rows (unit, side,
    node, copies, sig, shingles); root is the node's representative in the unit."""
    least = least_matches(num / den, TOLERANCE)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("node", kind="stable").reset_index(drop=True)
        same = part["same"].iloc[0]
        left = part if same else part[part["side"] == 0].reset_index(drop=True)
        right = part if same else part[part["side"] == 1].reset_index(drop=True)
        nodes = np.concatenate([left["node"], [] if same else right["node"]]).astype(np.int64)
        copies = np.concatenate([left["copies"], [] if same else right["copies"]]).astype(np.int64)
        shift = 0 if same else len(left)
        texts, docs = np.zeros(len(nodes), np.int64), np.zeros(len(nodes), np.int64)
        root = np.arange(len(nodes))

        def find(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for i, js in compare(left, right, same, least, num, den) if len(left) and len(right) else ():
            js = js + shift
            texts[i] += len(js)
            docs[i] += copies[js].sum()
            texts[js] += 1
            docs[js] += copies[i]
            for j in js.tolist():
                a, b = find(i), find(j)
                if a != b:
                    root[max(a, b)] = min(a, b)
        at = np.flatnonzero(texts)
        return pd.DataFrame({"node": nodes[at], "texts": texts[at], "docs": docs[at],
                             "root": nodes[[find(x) for x in at.tolist()]]})

    return groups.groupBy("group", "low", "high").applyInPandas(run, "node long, texts long, docs long, root long")


def near_rows(documents: DataFrame, num: int = 4, den: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest, class_id, copy_id, head, n_links, n_texts) of every row; head (none, id,
    digest) names the class's first row: the smallest id that is not null, and of rows
    with that id the smallest digest of a text.  Rows without shingles are their own."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = documents.select(F.col(id_col).alias("id"), text.alias("text"), F.md5(text.cast("binary")).alias("digest"))
    signed = materialize(signatures(docs), "jaccard-signatures")
    own = F.struct(F.col("id").isNull().alias("none"), "id", "digest")
    nodes = (signed.where("fp is not null").groupBy("fp")
             .agg(F.min(own).alias("first"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"),
                  F.first("sig").alias("sig"), F.first("bands").alias("bands")))
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "jaccard-nodes")

    keys = nodes.select("node", F.explode("bands").alias("key"))
    hubs = keys.groupBy("key").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("c")).where("c > 1")
    stars = keys.join(hubs.select("key", "hub"), "key").where("node <> hub").select("hub", "node").distinct()
    groups = connected_components(materialize(stars, "jaccard-stars"), src="hub", dst="node", vid="node")
    groups = materialize(groups.join(nodes.select("node", "fp", "first", "copies", "n", "sig"), "node"), "jaccard-groups")

    # each set is fetched from one text: of many rows with one id, or none, only those with its digest
    wanted = groups.select(F.col("first.id").alias("of"), F.col("first.digest").alias("digest"), F.col("fp").alias("want"))
    sets = docs.join(wanted, "digest").where(F.col("id").eqNullSafe(F.col("of")))
    sets = materialize(sets_of(sets).dropDuplicates(["fp"]), "jaccard-sets")
    # groups of more than one block are few: one for each BLOCK_NODES nodes at most
    large = groups.groupBy(F.col("component").alias("of")).agg(F.ceil(F.count(F.lit(1)) / BLOCK_NODES + F.sum("n") / BLOCK_SHINGLES)
                                                               .cast("int").alias("many")).where("many > 1")
    dealt = (groups.join(materialize(large, "jaccard-large"), F.col("component") == F.col("of"), "left").join(sets, "fp")
             .withColumn("blocks", F.coalesce("many", F.lit(1)))
             .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))))
    units = dealt.select(F.col("component").alias("group"), F.least("block", "other").alias("low"),
                         F.greatest("block", "other").alias("high"), (F.col("block") == F.col("other")).alias("same"),
                         (F.col("block") > F.col("other")).cast("int").alias("side"),
                         "node", "copies", "sig", "shingles")
    found = materialize(links(units, num, den), "jaccard-links")

    classes = connected_components(found.where("node <> root"), found.select(F.col("node").alias("id")),
                                   src="node", dst="root", vid="id").withColumnRenamed("id", "node")
    counts = found.groupBy("node").agg(F.sum("texts").alias("texts"), F.sum("docs").alias("docs"))
    by_node = (nodes.select("node", "fp", "first", "copies").join(counts, "node", "left").join(classes, "node", "left")
               .withColumn("component", F.coalesce("component", "node")))
    smallest = by_node.groupBy("component").agg(F.min("first").alias("head"))
    by_node = by_node.join(smallest, "component").select(
        "fp", "head", F.col("first.id").alias("copy_id"),
        (F.coalesce("docs", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("texts", F.lit(0)).alias("n_texts"))
    out = signed.select("id", "digest", "fp").join(by_node, "fp", "left").withColumn("head", F.coalesce("head", own))
    return out.select("id", "digest", F.col("head.id").alias("class_id"),
                      F.when(F.col("fp").isNull(), F.col("id")).otherwise(F.col("copy_id")).alias("copy_id"), "head",
                      F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      F.coalesce("n_texts", F.lit(0)).cast("long").alias("n_texts"))


def join_near(documents: DataFrame, num: int = 4, den: int = 5, id_col: str = "doc_id",
              text_col: str = "text") -> DataFrame:
    """(id, class_id, copy_id, n_links, n_texts) of every row: its class (documents
    joined by chains of links or copies), the smallest id with an equal set, the
    other documents that it links to, and how many different sets those have.
    The threshold is num / den, at least 0.8 for the bands used here."""
    rows = near_rows(documents, num, den, id_col, text_col)
    return rows.select(F.col("id").alias(id_col), "class_id", "copy_id", "n_links", "n_texts")


def keep_first(documents: DataFrame, num: int = 4, den: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with one row of each class, its first (``near_rows``).  Rows are told
    apart by id and text, so an id that occurs with several texts loses none that is
    its class's first; rows alike in both are one row.  Texts without words all stay."""
    columns = documents.columns
    text = F.coalesce(F.col(text_col), F.lit(""))
    digest = F.md5(text.cast("binary"))
    near = materialize(near_rows(documents, num, den, id_col, text_col).where("n_links > 0"), "jaccard-near")
    first = F.col("id").eqNullSafe(F.col("head.id")) & (F.col("digest") == F.col("head.digest"))
    gone = near.where(~first).select(F.col("id").alias("_id"), F.col("digest").alias("_digest")).distinct()
    # first rows that occur more than once, by id and text
    again = near.where(first).groupBy(F.col("id").alias("_id"), F.col("digest").alias("_digest")).agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    marks = gone.withColumn("_again", F.lit(False)).unionByName(again.drop("c").withColumn("_again", F.lit(True)))
    marked = documents.join(marks, (digest == F.col("_digest")) & F.col(id_col).eqNullSafe(F.col("_id")), "left")
    once = marked.where("_again is null").select(*columns)
    one = marked.where("_again").groupBy("_digest", "_id").agg(F.min(F.struct(*columns)).alias("row")).select("row.*")
    return once.unionByName(one.select(*columns))
