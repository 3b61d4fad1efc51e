"""Packing: order-preserving dynamic programming over window cuts.

Each partition's documents form one stream of tokens, in their order.  Windows of
at most ``window`` tokens cut the stream; a window is padded to ``window`` unless
its length is a power of two.  The cuts minimise, over the stream's blocks,

    padding + sequence_cost per window + the cut's penalty:
    0 between documents, ``sentence_penalty`` between sentences,
    ``inside_penalty`` every ``stride`` tokens in a stretch longer than that
    without such a place.

For the padded transitions, cost(i, j) = window - (b_j - b_i), so the best i is a
sliding minimum of f(i) + b_i: a monotone queue.  Transitions of power-of-two
length are added one by one.  A block ends after ``block_tokens`` or with the
partition; its last window stays open and opens the next block, so only a
partition's last window is padded for want of documents.

Sequence ids are (partition << 32) + number, so no job has to number windows
globally.  Cases: a null or empty text is a document of the end token alone;
texts may be of any length; repeated rows are packed one after another; an empty
table gives no rows; columns other than the id and the text are ignored.
"""

from __future__ import annotations

import base64
import os
import re
import zlib
from collections import deque
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.pieces import UnitCache, sliced

#: A space between two characters that are not white space starts a token of its
#: own in byte-level pre-tokenisation: texts can be cut there.
LOOSE_SPACE = re.compile(r"\s\s|\A | \Z")
CUT = re.compile(r"(?<=\S) (?=\S)")


def splits_at_spaces(text: str) -> bool:
    """Whether every space stands alone between words: the lengths of the words tell for
    most texts, without a look at every character."""
    words = text.split()
    return sum(map(len, words)) + len(words) - 1 == len(text) or not LOOSE_SPACE.search(text)


class Costs(NamedTuple):
    window: int = 1024
    sequence_cost: int = 16
    sentence_penalty: int = 2
    inside_penalty: int = 32
    stride: int = 64
    block_tokens: int = 1 << 18


def best_cuts(places: np.ndarray, penalty: np.ndarray, costs: Costs) -> list[int]:
    """Indices into ``places`` of the cuts of least cost, last one included.
    ``places``: ascending from 0, neighbours at most ``window`` apart."""
    w = costs.window
    to, at = [], []         # transitions of power-of-two length, by their end
    for k in range(w.bit_length()):
        i = np.searchsorted(places, places - (1 << k))
        to.append(np.flatnonzero((places[i] == places - (1 << k)) & (places >= 1 << k)))
        at.append(i[to[-1]])
    to, at = np.concatenate(to), np.concatenate(at)
    exact, first = at[np.argsort(to, kind="stable")].tolist(), np.cumsum(np.bincount(to + 1, minlength=len(places) + 1)).tolist()
    b, pen = places.tolist(), penalty.tolist()
    f, came = [0] * len(b), [0] * len(b)
    queue = deque([0])
    key = [0] * len(b)
    for j in range(1, len(b)):
        here = b[j]
        while here - b[queue[0]] > w:
            queue.popleft()
        i = queue[0]
        best = key[i] + w - here
        for i2 in exact[first[j]:first[j + 1]]:
            if f[i2] < best:
                best, i = f[i2], i2
        best += costs.sequence_cost + pen[j]
        f[j], came[j] = best, i
        key[j] = k = best + here
        while queue and key[queue[-1]] >= k:
            queue.pop()
        queue.append(j)
    cuts, j = [], len(b) - 1
    while j:
        cuts.append(j)
        j = came[j]
    return cuts[::-1]


class Tokens:
    """Ids of whole texts, by units that repeat.  ``ranks_path`` names the same
    vocabulary as ranks, if there is such a file: its library gives the same ids
    for text without special strings, several times faster."""

    def __init__(self, path: str, ranks_path: str | None = None):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.fast = None
        if ranks_path:
            import public_tokenizers
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                          special_tokens={})
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.cache = UnitCache(self.units)
        vocab = {i: t for t, i in self.tokenizer.get_vocab(with_added_tokens=True).items()}
        names = [vocab.get(i, "") for i in range(max(vocab) + 1)]
        self.stops = np.array([n[-1:] in (".", "!", "?", "Ċ") for n in names])   # Ċ, Ġ: line end and space
        self.opens = np.array([n[:1] in ("Ġ", "Ċ") for n in names])
        self.spaced = np.array([n[:1] == "Ġ" for n in names])

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes()
                for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def plain(self, text: str) -> list[int]:
        if self.fast and not any(t in text for t in self.special):
            return self.fast.encode_ordinary(text)
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def units(self, keys: list[str]) -> list[bytes]:
        """Ids of units with a space in front.  Units without further spaces are
        encoded as one text, in which a token with a space opens each."""
        plain = [k for k in keys if " " not in k]
        ids = np.array(self.plain(" " + " ".join(plain)) if plain else [], "<u4")
        starts = np.flatnonzero(self.spaced[ids])
        data, ends = ids.tobytes(), [*(4 * starts[1:]).tolist(), 4 * len(ids)]
        known = dict(zip(plain, [data[a:b] for a, b in zip((4 * starts).tolist(), ends)], strict=True)) if plain else {}
        other = [k for k in keys if " " in k]
        known.update(zip(other, self.whole([" " + k for k in other])))
        return [known[k] for k in keys]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        units = [t.split(" ") if splits_at_spaces(t) else CUT.split(t) for t in texts]
        heads = self.whole([u[0] for u in units])
        got = self.cache.values([x for u in units for x in u[1:]])
        out, at = [], 0
        for head, u in zip(heads, units):
            out.append(np.frombuffer(b"".join([head, *got[at:at + len(u) - 1]]), "<u4"))
            at += len(u) - 1
        return out


class Packer:
    """Packs one partition's documents as they come."""

    def __init__(self, tokens: Tokens, costs: Costs, first_sequence: int):
        self.tokens, self.costs, self.sequence = tokens, costs, first_sequence
        self.docs: list[tuple] = []     # (id, tokens not packed yet, tokens packed, all tokens)
        self.size = 0

    def add(self, key, ids: np.ndarray, end_id: int):
        ids = np.append(ids, np.uint32(end_id)).astype("<u4")
        self.docs.append((key, ids, 0, len(ids)))
        self.size += len(ids)

    def places(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cut places of a block and their penalties."""
        known = np.minimum(ids, len(self.tokens.stops) - 1)
        sentence = np.flatnonzero(self.tokens.stops[known[:-1]] & self.tokens.opens[known[1:]]) + 1
        natural = np.unique(np.concatenate([[0], sentence, ends]))
        gaps = np.diff(natural)
        inner = (gaps - 1) // self.costs.stride
        steps = np.arange(int(inner.sum())) - np.repeat(np.cumsum(inner) - inner, inner) + 1
        more = np.repeat(natural[:-1], inner) + steps * self.costs.stride
        places = np.union1d(natural, more)
        penalty = np.full(len(places), self.costs.inside_penalty, np.int64)
        penalty[np.searchsorted(places, sentence)] = self.costs.sentence_penalty
        penalty[np.searchsorted(places, ends)] = 0
        penalty[0] = 0
        return places, penalty

    def flush(self, last: bool):
        """Rows of the block's windows; all but the last window unless ``last``."""
        if not self.docs:
            return None
        ids = np.concatenate([d[1] for d in self.docs])
        ends = np.cumsum([len(d[1]) for d in self.docs])
        places, penalty = self.places(ids, ends)
        cuts = places[best_cuts(places, penalty, self.costs)]
        if not last:
            cuts = cuts[:-1]
            if not len(cuts):
                return None
        stop = int(cuts[-1])
        starts = np.append(0, cuts[:-1])
        begins = np.append(0, ends[:-1])
        edge = np.unique(np.concatenate([starts, begins[begins < stop]]))
        size = np.diff(np.append(edge, stop))
        doc = np.searchsorted(begins, edge, "right") - 1
        window = np.searchsorted(starts, edge, "right") - 1
        data = memoryview(ids.astype("<u4").tobytes())
        rows = {
            "id": [self.docs[d][0] for d in doc.tolist()],
            "start": edge - begins[doc] + np.array([d[2] for d in self.docs])[doc],
            "length": size,
            "ids_crc32": [zlib.crc32(data[4 * a:4 * (a + n)]) for a, n in zip(edge.tolist(), size.tolist())],
            "doc_tokens": np.array([d[3] for d in self.docs])[doc],
            "sequence_id": self.sequence + window,
            "offset": edge - starts[window],
        }
        self.sequence += len(cuts)
        rest = []
        for (key, own, packed, total), a, e in zip(self.docs, begins.tolist(), ends.tolist()):
            if e > stop:
                skip = max(0, stop - a)
                rest.append((key, own[skip:], packed + skip, total))
        self.docs, self.size = rest, int(ends[-1]) - stop
        return rows


def pack(documents: DataFrame, tokenizer_path: str, ranks_path: str | None = None, costs: Costs = Costs(),
         end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: (id, start, length, ids_crc32, doc_tokens, sequence_id, offset)."""
    docs = documents.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = docs.schema["id"].dataType.simpleString()
    names = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches):
        packer = Packer(Tokens(tokenizer_path, ranks_path), costs, TaskContext.get().partitionId() << 32)
        id_type = pa.int64()

        def rows(got):
            return pa.RecordBatch.from_arrays(
                [pa.array(got["id"], id_type), *[pa.array(got[n], pa.int64()) for n in names]], ["id", *names])

        for batch in batches:
            id_type = batch.schema.field("id").type
            keys, at = batch.column("id").to_pylist(), 0
            for part in sliced(batch.column("text").to_pylist()):
                for ids in packer.tokens.encode(part):
                    packer.add(keys[at], ids, end_id)
                    at += 1
                    if packer.size >= costs.block_tokens and (got := packer.flush(False)):
                        yield rows(got)
        if got := packer.flush(True):
            yield rows(got)

    return (docs.mapInArrow(run, f"id {kind}, " + ", ".join(f"{n} long" for n in names))
            .withColumnRenamed("id", id_col))
