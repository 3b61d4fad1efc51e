"""Exact top-k search over a bit-sliced index.

Rows are dealt into blocks of about ``ROW_BLOCK`` rows or ``BLOCK_BYTES`` bytes.  A
block's index, a row of a written table, holds for every attribute the ``SLICES`` most
significant bits of (value - block minimum) as bitmaps over the block's rows, and the
values themselves.

For a query, an attribute of weight q contributes |q| times its sliced number
(its complement where q < 0).  All slices of one binary weight form a column;
columns are added with carry-save adders on whole bitmaps, which gives the slices
of every row's coarse score.  The k-th coarse score is found from the most
significant slice downward.  Rows within the width that the dropped low bits can
make up are the boundary; their scores are computed exactly from the values.  So
the answer is exact whatever the number of slices.

Queries, a hundredth of the rows, travel to the blocks: a unit of work is a block and a
group of at most ``QUERY_GROUP`` queries, so a block is sent once a group and opened
once.  The best k of each unit meet in a ranked window.

Components are whole numbers of any size.  Where products could pass 64 bits, Python's
integers take numpy's place; a score beyond 64 bits is ranked exactly and returned as
the nearest long.

Cases: vectors that are null or hold null or non-finite components, or ones whose
multiple by ``scale`` is infinite, take no part;
a shorter vector counts as padded with zeros; rows that share the query's id are
its own and no candidates, and a repeated query id is asked once, with its
smallest vector; repeated candidate rows are candidates each; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlens.operators.store import materialize

SLICES = 8
ROW_BLOCK, BLOCK_BYTES = 32_768, 32 << 20
QUERY_GROUP, GROUP_BYTES = 16_384, 16 << 20
SAFE = 1 << 61           # numbers up to here, and their differences, are 64-bit
LONG = (1 << 63) - 1


def quantised(vectors: DataFrame, scale: int, id_col: str, vec_col: str) -> DataFrame:
    """(id, v array<double>) of the vectors that take part; the numbers are whole."""
    v = F.col(vec_col).cast("array<double>")
    # a component so large that its multiple is infinite can't be quantised
    whole = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * scale) < float("inf")))
    cut = lambda x: F.when(F.abs(x) < 2.0 ** 52, F.floor(x * scale).cast("double")).otherwise(x * scale)
    return (vectors.where(F.coalesce(whole, F.lit(False)))
            .select(F.col(id_col).alias("id"), F.transform(v, cut).alias("v")))


def _matrix(lists) -> np.ndarray:
    width = max((len(x) for x in lists), default=0)
    if all(len(x) == width for x in lists):
        return np.array(list(lists), np.float64).reshape(len(lists), width)
    return np.array([list(x) + [0.0] * (width - len(x)) for x in lists], np.float64)


def whole_numbers(m: np.ndarray) -> np.ndarray:
    """Doubles that are whole, as 64-bit numbers or, where one is too large, as Python's."""
    if np.abs(m).max(initial=0) <= SAFE:
        return m.astype(np.int64)
    return np.array([[int(x) for x in row] for row in m], object).reshape(m.shape)


def _fit(m: np.ndarray, width: int) -> np.ndarray:
    return m if m.shape[1] >= width else np.pad(m, ((0, 0), (0, width - m.shape[1])))


class Block:
    """Bit-sliced index of some rows: built from their values, or from a stored row."""

    def __init__(self, ids: np.ndarray, values: np.ndarray, slices: np.ndarray | None = None, drop: int = 0):
        self.ids, self.values = ids, whole_numbers(values)
        n = len(ids)
        self.words = (n + 63) // 64
        self.largest = int(np.abs(self.values).max(initial=0))
        if slices is None:
            part = self.values - self.values.min(axis=0) if n else self.values
            drop = max(0, int(part.max(initial=0)).bit_length() - SLICES)
            part = part >> drop
            slices = np.stack([self.bitmap((part >> s & 1).astype(bool).T) for s in range(SLICES)], axis=1)
        self.drop, self.slices = drop, slices.reshape(values.shape[1], SLICES, self.words)
        self.valid = self.bitmap(np.ones(n, bool))

    def bitmap(self, bits: np.ndarray) -> np.ndarray:
        pad = self.words * 64 - bits.shape[-1]
        bits = np.pad(bits, [(0, 0)] * (bits.ndim - 1) + [(0, pad)])
        return np.ascontiguousarray(np.packbits(bits, axis=-1, bitorder="little")).view(np.uint64)

    def rows(self, bitmap: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))

    def coarse(self, q: np.ndarray) -> list[np.ndarray]:
        """Slices of each row's coarse score, least significant first."""
        size = np.abs(q)
        signed = self.slices ^ np.where((q < 0).astype(bool), ~np.uint64(0), np.uint64(0))[:, None, None]
        columns: dict[int, list[np.ndarray]] = {}
        for b in range(int(size.max(initial=0)).bit_length()):
            own = signed[np.flatnonzero((size >> b & 1).astype(bool))]
            for s in range(SLICES):
                columns.setdefault(b + s, []).append(own[:, s])
        out, w = [], 0
        while w in columns or any(k > w for k in columns):
            piles = columns.pop(w, [])
            pile = np.concatenate(piles) if piles else np.zeros((0, self.words), np.uint64)
            while len(pile) > 1:
                k = len(pile) // 3
                if k:
                    a, b, c = pile[:k], pile[k:2 * k], pile[2 * k:3 * k]
                    x = a ^ b
                    up, pile = (a & b) | (x & c), np.concatenate([x ^ c, pile[3 * k:]])
                else:
                    up, pile = pile[:1] & pile[1:], pile[:1] ^ pile[1:]
                columns.setdefault(w + 1, []).append(up)
            out.append(pile[0] if len(pile) else np.zeros(self.words, np.uint64))
            w += 1
        return out

    def boundary(self, q: np.ndarray, k: int, own: np.ndarray) -> np.ndarray:
        """Row numbers that can be among the k best of a query."""
        valid = self.valid
        if len(own):
            valid = valid.copy()
            np.bitwise_and.at(valid, own // 64, ~(np.uint64(1) << (own % 64).astype(np.uint64)))
        if int(np.bitwise_count(valid).sum()) <= k:
            return self.rows(valid)
        score = self.coarse(q)
        sure, equal, kth = np.zeros_like(valid), valid, 0
        for w in range(len(score) - 1, -1, -1):
            top = equal & score[w]
            if int(np.bitwise_count(sure | top).sum()) >= k:
                equal, kth = top, kth | 1 << w
            else:
                sure, equal = sure | top, equal & ~score[w]
        # the dropped bits add less than 2^drop per unit of weight
        slack = ((1 << self.drop) - 1) * sum(map(abs, q.tolist()))
        least = kth - (slack >> self.drop) - 1 if slack else kth
        if least <= 0:
            return self.rows(valid)
        above, equal = np.zeros_like(valid), valid
        for w in range(max(len(score), least.bit_length()) - 1, -1, -1):
            bit = score[w] if w < len(score) else np.zeros_like(valid)
            if least >> w & 1:
                equal = equal & bit
            else:
                above, equal = above | (equal & bit), equal & ~bit
        return self.rows(above | equal)

    def best(self, query_id: int, q: np.ndarray, k: int) -> list[tuple[int, int]]:
        """(score, id) of the k best rows, ties to the smaller id.  A query is as wide as
        the block at least."""
        inner, values = q[:self.values.shape[1]], self.values
        at = self.boundary(inner, k, np.flatnonzero(self.ids == query_id))
        values = values[at]
        if self.largest * sum(map(abs, inner.tolist())) > LONG:
            values, inner = values.astype(object), inner.astype(object)
        scores = values @ inner if values.shape[1] else np.zeros(len(at), np.int64)
        if scores.dtype == object:
            return sorted(zip(scores.tolist(), self.ids[at].tolist()), key=lambda z: (-z[0], z[1]))[:k]
        order = np.lexsort((self.ids[at], -scores))[:k]
        return list(zip(scores[order].tolist(), self.ids[at][order].tolist()))


def beyond(score: int) -> str:
    """Orders scores that the same nearest long stands for, larger ones later."""
    if -LONG <= score <= LONG:
        return ""
    digits = str(abs(score))
    if score > 0:
        return f"{len(digits):04d}{digits}"
    return f"{9999 - len(digits):04d}" + "".join(str(9 - int(d)) for d in digits)


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, scale: int = 1024, id_col: str = "vec_id",
          vec_col: str = "embedding", block_rows: int = ROW_BLOCK, query_rows: int = QUERY_GROUP) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows of each query."""
    rows = materialize(quantised(vectors, scale, id_col, vec_col).where("id is not null"), "top-k-rows")
    asked = F.col("id") % every == 0
    sizes = rows.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(asked, 1)).alias("q"), F.max(F.size("v")).alias("width")).first()
    width = max(sizes["width"] or 0, 1)
    block_rows, query_rows = max(1, min(block_rows, BLOCK_BYTES // (8 * width))), max(1, min(query_rows, GROUP_BYTES // (8 * width)))
    n_blocks, n_groups = -(-sizes["n"] // block_rows) or 1, -(-sizes["q"] // query_rows) or 1

    def build(key, part: pd.DataFrame) -> pd.DataFrame:
        values = _matrix(part["v"])
        b = Block(part["id"].to_numpy(np.int64), values)
        return pd.DataFrame({"block": [key[0]], "ids": [b.ids.tobytes()], "width": [values.shape[1]], "data": [values.tobytes()],
                             "slices": [np.ascontiguousarray(b.slices).tobytes()], "drop": [b.drop]})

    place = F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(n_blocks)).cast("int")
    index = materialize(rows.withColumn("block", place).groupBy("block").applyInPandas(
        build, "block int, ids binary, width int, data binary, slices binary, drop int"), "top-k-index")
    queries = rows.where(asked).groupBy("id").agg(F.min("v").alias("v"))
    queries = queries.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(n_groups)).cast("int")).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    parts = index.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1))))

    def search(held: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(held) and len(asked):
            r = held.iloc[0]
            ids = np.frombuffer(r["ids"], np.int64)
            values = np.frombuffer(r["data"], np.float64).reshape(len(ids), r["width"])
            block = Block(ids, values, np.frombuffer(r["slices"], np.uint64), int(r["drop"]))
            for i, v in zip(asked["id"].tolist(), asked["v"]):
                q = whole_numbers(_fit(np.asarray(v, np.float64)[None], r["width"]))[0]
                out += [(i, c, max(-LONG - 1, min(LONG, s)), beyond(s)) for s, c in block.best(i, q, k)]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score", "beyond"])

    found = (parts.groupBy("block", "part").cogroup(queries.groupBy("block", "part"))
             .applyInPandas(search, "query_id long, vec_id long, score long, beyond string"))
    ranked = found.withColumn("rank", F.row_number().over(
        Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("beyond"), "vec_id")).cast("int"))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
