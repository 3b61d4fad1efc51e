"""SentencePiece encoding and decoding as a weighted finite-state transducer.

Three transducers are compiled from a piece model:

* normaliser: a space becomes the space mark, a text gets one mark in front;
* pieces: every piece is an arc from its characters to its id; a character
  without a piece is an arc to the ids of its UTF-8 bytes (byte fallback);
* follower: which piece may follow which.  Weight 0 if merging the two pieces'
  characters by the model's rule ends in exactly these two pieces, infinity
  otherwise.

A BPE model picks merges by rank, so a sum of piece scores would give another
segmentation.  The follower weights make the tropical shortest path exact: no
merge crosses a border between two tokens of the model's segmentation, and what
happens left and right of a border is the same in the whole text as in the two
tokens alone.  So a path of finite weight exists for every prefix of a text,
exactly one, and it is the model's segmentation.

Composition and shortest path run over all distinct units of a slice of texts at
once: arcs by a trie over the ragged character array, then position by position
the one arc whose follower weight is finite.  ``decode`` is the inverse
transducer: ids to bytes, space marks to spaces, without the mark in front.

Cases: a null or empty text has no ids; texts may be of any length; repeated rows
are encoded alike; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.pieces import BYTE, NORMAL, SPACE, KeyMap, PieceModel, UnitCache, read_model, sliced, unit_keys, unit_text

LOWEST = -np.inf
KNOWN_BITS = 20


class Transducer:
    """Arrays of the three transducers."""

    def __init__(self, model: PieceModel):
        self.dummy_prefix = model.dummy_prefix
        names = [p for p, k in zip(model.pieces, model.kinds) if k == NORMAL]
        score = {p: s for p, s, k in zip(model.pieces, model.scores, model.kinds) if k == NORMAL}
        chars = sorted({c for p in names for c in p})
        symbol = {p: n for n, p in enumerate(dict.fromkeys(chars + names))}   # 0 .. len - 1
        self.unknown = len(symbol)                                            # any other character
        self._compile_ids(model, symbol)
        self._compile_follower(symbol, score)
        self._compile_trie(symbol, score)

    def _compile_ids(self, model, symbol) -> None:
        """Ids of each symbol, flat; for the unknown character they depend on it."""
        at = {p: i for i, (p, k) in enumerate(zip(model.pieces, model.kinds)) if k == NORMAL}
        self.byte_ids = np.array(model.byte_ids, np.uint32)
        ids = [[at[s]] if s in at else [model.byte_ids[b] for b in s.encode()] for s in symbol]
        self.id_size = np.array([len(x) for x in ids] + [0], np.int64)
        self.id_start = np.append(0, np.cumsum(self.id_size))[:-1]
        self.id_flat = np.array([x for one in ids for x in one], np.uint32)
        out = [b"" if k not in (NORMAL, BYTE) else p.replace(SPACE, " ").encode() if k == NORMAL
               else bytes([int(p[3:5], 16)]) for p, k in zip(model.pieces, model.kinds)]
        self.out_size = np.array([len(x) for x in out], np.int64)
        self.out_start = np.append(0, np.cumsum(self.out_size))[:-1]
        self.out_flat = np.frombuffer(b"".join(out), np.uint8)

    def _compile_follower(self, symbol, score) -> None:
        """For each symbol the scores of the merges that make it, in order, and its
        first and last part before each of them; and the scores of all pairs."""
        pairs, n = {}, len(symbol) + 1
        for p, s in score.items():
            for k in range(1, len(p)):
                if p[:k] in symbol and p[k:] in symbol:
                    pairs[symbol[p[:k]] * n + symbol[p[k:]]] = s
        self.n = n
        self.pairs = KeyMap(np.array(sorted(pairs), np.int64))
        self.pair_score = np.array([pairs[k] for k in sorted(pairs)] + [LOWEST])   # last: no pair
        self.known = np.full(1 << KNOWN_BITS, -1, np.int64)      # pairs judged lately, times 2, plus the verdict
        longest = max(map(len, symbol))
        self.steps = np.full((n, longest), LOWEST)
        self.head = np.empty((n, longest), np.int32)
        self.tail = np.empty((n, longest), np.int32)
        self.whole = np.ones(n, bool)         # does merging its characters end in the symbol itself?
        self.head[-1] = self.tail[-1] = n - 1
        for text, k in symbol.items():
            parts, heads, tails, events = list(text), [], [], []
            while True:
                heads.append(symbol[parts[0]])
                tails.append(symbol[parts[-1]])
                best = max(range(len(parts) - 1), default=None,
                           key=lambda i: (score.get(parts[i] + parts[i + 1], LOWEST), -i))
                if best is None or parts[best] + parts[best + 1] not in score:
                    break
                events.append(score[parts[best] + parts[best + 1]])
                parts[best:best + 2] = [parts[best] + parts[best + 1]]
            self.whole[k] = len(parts) == 1
            self.steps[k, :len(events)] = events
            for table, row in ((self.head, heads), (self.tail, tails)):
                table[k] = row + [row[-1]] * (longest - len(row))

    def _compile_trie(self, symbol, score) -> None:
        """Arcs from (state, character) to a state, and each state's symbol."""
        self.char = np.full(0x110000, -1, np.int32)
        self.of_char = np.full(0x110000, self.unknown, np.int32)
        alphabet: dict[str, int] = {}
        for s, k in symbol.items():
            if len(s) == 1:
                alphabet[s] = len(alphabet)
                self.char[ord(s)] = alphabet[s]
                self.of_char[ord(s)] = k
        self.width = len(alphabet) + 1
        arcs: dict[int, int] = {}
        ends = {0: -1}
        for s, k in symbol.items():
            if not self.whole[k]:
                continue
            state = 0
            for c in s:
                state = arcs.setdefault(state * self.width + alphabet[c], len(arcs) + 1)
            ends[state] = k
        self.arcs = KeyMap(np.array(sorted(arcs), np.int64))
        self.arc_to = np.array([arcs[k] for k in sorted(arcs)] + [-1], np.int64)   # last: no arc
        self.end = np.full(len(arcs) + 1, -1, np.int32)
        for s, k in ends.items():
            self.end[s] = k
        self.longest = max(map(len, symbol))

    def finite(self, left, right):
        """Is the follower weight of these pairs of symbols 0 (else infinite)?
        Pairs judged lately are read from a direct-mapped table."""
        key = left.astype(np.int64) * self.n + right
        slot = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - KNOWN_BITS)).astype(np.int64)
        seen = self.known[slot]
        ok = (seen & 1).astype(bool)
        new = np.flatnonzero(seen >> 1 != key)
        if len(new):
            ok[new] = got = self._judge(left[new], right[new])
            self.known[slot[new]] = key[new] << 1 | got
        return ok

    def _judge(self, left, right):
        """Runs the merges of both symbols side by side, best score first, leftmost
        on ties, and looks whether one across the border comes before."""
        ok = np.ones(len(left), bool)
        going = np.flatnonzero((left != self.unknown) & (right != self.unknown))
        a, b = left[going], right[going]
        i = np.zeros(len(going), np.int64)
        j = np.zeros(len(going), np.int64)
        while len(going):
            here = self.pair_score[self.pairs.find(self.tail[a, i].astype(np.int64) * self.n + self.head[b, j])]
            la, lb = self.steps[a, i], self.steps[b, j]
            cross = (here > la) & (here >= lb) & (here > LOWEST)
            ok[going[cross]] = False
            on_left = la >= lb
            more = ~cross & ((la > LOWEST) | (lb > LOWEST))
            i, j = (i + on_left)[more], (j + ~on_left)[more]
            going, a, b = going[more], a[more], b[more]
        return ok

    def encode_units(self, units: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each unit."""
        if not units:
            return []
        codes = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        starts = np.cumsum(sizes) - sizes
        arcs = self._arcs(codes, starts, sizes)
        last, took = self._paths(arcs, codes, starts, sizes)
        return self._read_back(last, took, codes, starts, sizes)

    def _arcs(self, codes, starts, sizes):
        """arcs[k, p]: symbol of the piece of k + 1 characters that ends before p + 1, or -1."""
        n = len(codes)
        arcs = np.full((self.longest, n), -1, np.int32)
        arcs[0] = self.of_char[codes]
        char = self.char[codes]
        left = np.repeat(starts + sizes, sizes) - np.arange(n)      # characters up to the unit's end
        at = np.flatnonzero(char >= 0)
        state = np.zeros(len(at), np.int64)
        for k in range(self.longest):
            state = self.arc_to[self.arcs.find(state * self.width + char[at + k])]
            live = state >= 0
            at, state = at[live], state[live]
            if k:
                arcs[k, at + k] = self.end[state]
            more = left[at] > k + 1
            at, state = at[more], state[more]
            more = char[at + k + 1] >= 0 if len(at) else more[:0]
            at, state = at[more], state[more]
            if not len(at):
                return arcs[:k + 1]
        return arcs

    def _paths(self, arcs, codes, starts, sizes):
        """Symbol and length of the last arc of each prefix's one finite path."""
        last = np.full(len(codes), -1, np.int32)
        took = np.zeros(len(codes), np.int32)
        order = np.argsort(-sizes, kind="stable")
        begin, by_size = starts[order], -sizes[order]
        for p in range(int(sizes.max())):
            units = begin[:np.searchsorted(by_size, -p, "left")]   # those with more than p characters
            at = units + p
            for k in range(min(p + 1, len(arcs)) - 1, -1, -1):     # long arcs first
                if not len(at):
                    break
                arc = arcs[k, at]
                can = np.flatnonzero(arc >= 0)
                if p > k and len(can):
                    can = can[self.finite(last[at[can] - k - 1], arc[can])]
                last[at[can]] = arc[can]
                took[at[can]] = k + 1
                open_ = np.ones(len(at), bool)
                open_[can] = False
                at = at[open_]
            if len(at):
                raise AssertionError("a prefix without a finite path")
        return last, took

    def _read_back(self, last, took, codes, starts, sizes):
        on = np.zeros(len(codes), bool)         # ends of the tokens on the paths
        at, begin = starts + sizes - 1, starts
        while len(at):
            on[at] = True
            at = at - took[at]
            more = at >= begin
            at, begin = at[more], begin[more]
        ends = np.flatnonzero(on)
        symbols = last[ends]
        size = self.id_size[symbols]
        strange = symbols == self.unknown
        coded = [chr(c).encode("utf-8", "surrogatepass") for c in codes[ends[strange]]]
        size[strange] = [len(x) for x in coded]
        into = np.cumsum(size) - size
        out = np.zeros(int(size.sum()), np.uint32)
        plain = np.flatnonzero(~strange)
        one = plain[size[plain] == 1]
        out[into[one]] = self.id_flat[self.id_start[symbols[one]]]
        for k in plain[size[plain] > 1]:
            s = self.id_start[symbols[k]]
            out[into[k]:into[k] + size[k]] = self.id_flat[s:s + size[k]]
        for k, b in zip(np.flatnonzero(strange), coded):
            out[into[k]:into[k] + len(b)] = self.byte_ids[list(b)]
        per_unit = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[ends], weights=size, minlength=len(sizes))
        stops = (np.cumsum(per_unit) * 4).astype(np.int64)
        data = out.astype("<u4").tobytes()
        return [data[a:b] for a, b in zip(np.append(0, stops[:-1]).tolist(), stops.tolist())]

    def cache(self) -> UnitCache:
        return UnitCache(lambda keys: self.encode_units([unit_text(k, self.dummy_prefix) for k in keys]))

    def encode(self, texts: list[str], cache: UnitCache | None = None) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        cache = self.cache() if cache is None else cache
        out = []
        for part in sliced(texts):
            keys = [unit_keys(t, self.dummy_prefix) for t in part]
            got = cache.values(list(chain.from_iterable(keys)))
            ends = list(accumulate(map(len, keys)))
            out += [b"".join(got[e - len(k):e]) for k, e in zip(keys, ends)]
        return out

    def decode(self, ids: bytes) -> str:
        """Text of little-endian 32-bit ids; broken UTF-8 becomes U+FFFD."""
        k = np.frombuffer(ids, "<u4").astype(np.int64)
        size = self.out_size[k]
        total = int(size.sum())
        at = np.arange(total) + np.repeat(self.out_start[k] - (np.cumsum(size) - size), size)
        text = self.out_flat[at].tobytes().decode("utf-8", "replace")
        return text[1:] if self.dummy_prefix and text[:1] == " " else text


def encode_documents(documents: DataFrame, model_path: str, id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """(id, ids binary, n_tokens, decoded) of every row; ids little-endian 32-bit."""
    # as large as the piece model, whatever the table
    shared = documents.sparkSession.sparkContext.broadcast(Transducer(read_model(model_path)))
    docs = documents.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches):
        fst = shared.value
        cache = fst.cache()
        for batch in batches:
            texts = batch.column("text").to_pylist()
            ids = fst.encode(texts, cache)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64()),
                 pa.array([zlib.crc32(x) for x in ids], pa.int64()), pa.array([fst.decode(x) for x in ids]),
                 batch.column("text")],
                ["id", "ids", "n_tokens", "ids_crc32", "decoded", "text"])

    kind = docs.schema["id"].dataType.simpleString()
    out = docs.mapInArrow(run, f"id {kind}, ids binary, n_tokens long, ids_crc32 long, decoded string, text string")
    return out.withColumnRenamed("id", id_col)
