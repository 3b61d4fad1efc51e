"""Token counts by rank-synchronous array merging.

Texts are split into units that merges never cross.  The distinct units of a
slice of texts are held as one ragged array of symbols.  In every round each
unit's pair of lowest rank (best score, leftmost on ties) is merged, in all units
at once; units without a pair left are done, and their surviving symbols are
counted (a character without a piece counts its UTF-8 bytes).  Long units are
first cut where no piece holds both neighbouring characters; a part that is still
long is merged one pair after another with a heap, by the same rule.

Cases: a null or empty text has no tokens; texts may be of any length; repeated
rows are counted alike; an empty table gives no rows; columns other than the id
and the text are ignored.
"""

from __future__ import annotations

import heapq
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.pieces import NORMAL, KeyMap, PieceModel, UnitCache, read_model, sliced, unit_keys, unit_text

NO_RANK = np.int64(1) << 30
LONG_UNIT, LONG_PART = 64, 512


class MergeTable:
    """Symbols, pairs and ranks of a piece model as arrays."""

    def __init__(self, model: PieceModel):
        normal = [i for i, k in enumerate(model.kinds) if k == NORMAL]
        names = [model.pieces[i] for i in normal]
        symbol = {p: n + 1 for n, p in enumerate(names)}     # 0: a character in no piece
        for c in sorted({c for p in names for c in p}):
            symbol.setdefault(c, len(symbol) + 1)
        self.n = len(symbol) + 1
        order = {s: r for r, s in enumerate(sorted({-model.scores[i] for i in normal}))}
        pairs = {}
        for i, p in zip(normal, names):
            for k in range(1, len(p)):
                a, b = symbol.get(p[:k]), symbol.get(p[k:])
                if a and b:
                    pairs[a * self.n + b] = (symbol[p], order[-model.scores[i]])
        self.keys = np.array(sorted(pairs), np.int64)
        self.rows = KeyMap(self.keys)
        self.merged = np.array([pairs[k][0] for k in self.keys] + [0], np.int32)   # last: no pair
        self.rank = np.array([pairs[k][1] for k in self.keys] + [NO_RANK], np.int64)
        self.of_char = np.zeros(0x110000, np.int32)
        for c, s in symbol.items():
            if len(c) == 1:
                self.of_char[ord(c)] = s
        self.is_piece = np.zeros(self.n, bool)
        self.is_piece[1:len(names) + 1] = True
        near = {ord(p[k]) << 21 | ord(p[k + 1]) for p in names for k in range(len(p) - 1)}
        self.near = np.array(sorted(near), np.int64)
        self.dummy_prefix = model.dummy_prefix

    def look(self, left, right):
        """(rank, merged symbol) of pairs; NO_RANK where they don't merge."""
        at = self.rows.find(left.astype(np.int64) * self.n + right)
        return self.rank[at], self.merged[at]

    def count(self, units: list[str]) -> list[int]:
        """Tokens of each unit."""
        if not units:
            return []
        text = "".join(units)
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        owner = np.repeat(np.arange(len(units)), sizes)
        symbols = self.of_char[codes]
        width = 1 + (codes >= 0x80).astype(np.int64) + (codes >= 0x800) + (codes >= 0x10000)
        weight = np.where(self.is_piece[symbols], 1, width)
        first = np.ones(len(codes), bool)
        first[1:] = owner[1:] != owner[:-1]
        if sizes.max() > LONG_UNIT:
            pair = codes[:-1] << 21 | codes[1:]
            at = np.minimum(np.searchsorted(self.near, pair), len(self.near) - 1)
            first[1:] |= (sizes[owner[1:]] > LONG_UNIT) & (self.near[at] != pair)
        part = np.cumsum(first) - 1
        length = np.bincount(part)
        total = np.zeros(len(units), np.int64)
        long = np.flatnonzero(length > LONG_PART)
        starts = np.flatnonzero(first)
        for k in long:
            s = slice(starts[k], starts[k] + length[k])
            total[owner[s.start]] += self.count_long(symbols[s], weight[s])
        if len(long):
            keep = ~np.isin(part, long)
            symbols, weight, owner, part = symbols[keep], weight[keep], owner[keep], part[keep]
        self._merge_all(symbols, weight, owner, part, total)
        return total.tolist()

    def _merge_all(self, symbols, weight, owner, part, total) -> None:
        def ranked(left, right, inside):
            rank, merged = self.look(left, right)
            return np.where(inside, rank, NO_RANK), merged

        rank = np.full(len(symbols), NO_RANK)
        merged = np.zeros(len(symbols), np.int32)
        if len(symbols) > 1:
            rank[:-1], merged[:-1] = ranked(symbols[:-1], symbols[1:], part[:-1] == part[1:])
        while len(symbols):
            first = np.ones(len(symbols), bool)
            first[1:] = part[1:] != part[:-1]
            starts = np.flatnonzero(first)
            best = np.minimum.reduceat(rank << 32 | np.arange(len(symbols)), starts)
            going = best >> 32 < NO_RANK
            stay = np.repeat(going, np.diff(np.append(starts, len(symbols))))
            if not going.all():
                done = ~stay
                np.add.at(total, owner[done], weight[done])
            if not going.any():
                return
            at = best[going] & 0xFFFFFFFF
            symbols[at] = merged[at]
            weight[at] = 1
            stay[at + 1] = False
            place = np.cumsum(stay) - 1
            at = place[at]
            symbols, weight, owner, part, rank, merged = (x[stay] for x in (symbols, weight, owner, part, rank, merged))
            last = np.ones(len(symbols), bool)
            last[:-1] = part[1:] != part[:-1]
            right = symbols[np.minimum(at + 1, len(symbols) - 1)]
            rank[at], merged[at] = ranked(symbols[at], right, ~last[at])
            before = at[at > 0] - 1
            rank[before], merged[before] = ranked(symbols[before], symbols[before + 1], ~last[before])

    def count_long(self, symbols, weight) -> int:
        """Tokens of one part: a heap of pairs over a linked list."""
        pairs = dict(zip(self.keys.tolist(), zip(self.rank.tolist(), self.merged.tolist())))
        s, w = symbols.tolist(), weight.tolist()
        after, before = list(range(1, len(s) + 1)), list(range(-1, len(s) - 1))
        heap = []

        def offer(i):
            j = after[i]
            if j < len(s) and (hit := pairs.get(s[i] * self.n + s[j])):
                heapq.heappush(heap, (hit[0], i, s[i], s[j], hit[1]))

        for i in range(len(s) - 1):
            offer(i)
        alive = [True] * len(s)
        while heap:
            _, i, a, b, m = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j >= len(s) or s[i] != a or s[j] != b:
                continue
            s[i], w[i], alive[j] = m, 1, False
            after[i] = after[j]
            if after[i] < len(s):
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return sum(x for x, a in zip(w, alive) if a)


def count_tokens(documents: DataFrame, model_path: str, limit: int = 4096,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row."""
    # as large as the piece model, whatever the table
    shared = documents.sparkSession.sparkContext.broadcast(MergeTable(read_model(model_path)))
    docs = documents.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches):
        table = shared.value
        cache = UnitCache(lambda keys: table.count([unit_text(k, table.dummy_prefix) for k in keys]))
        for batch in batches:
            counts = []
            for part in sliced(batch.column("text").to_pylist()):
                keys = [unit_keys(t, table.dummy_prefix) for t in part]
                got = np.array(cache.values(list(chain.from_iterable(keys))), np.int64)
                ends = np.cumsum([len(k) for k in keys])
                sums = np.append(0, np.cumsum(got))[ends]
                counts += np.diff(sums, prepend=0).tolist()
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("n_bytes"), pa.array(counts, pa.int64())],
                ["id", "n_bytes", "n_tokens"])

    kind = docs.schema["id"].dataType.simpleString()
    out = (docs.select("id", "text", F.octet_length("text").cast("long").alias("n_bytes"))
           .mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long"))
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
