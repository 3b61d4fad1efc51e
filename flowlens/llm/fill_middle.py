"""Fill-in-the-middle with a piecewise-linear learned rank index.

A text is cut into units (code points, words or lines, matched left to right), and a
rank's boundary is the byte offset at which that many units have ended.  Instead of
reading a text up to its cuts, the offsets of all boundaries of a slice of texts are
learned as a function of the rank:

1. Segments: from left to right, each the longest run of boundaries that one line
   from its first boundary meets within ``ERROR`` bytes (a cone of slopes that narrows
   until it is empty).  Text of one byte a unit is one segment, however long.
2. Residuals: the boundary minus the line's rounded value, one signed byte each.
3. A cut is predicted from its rank's segment and corrected by the stored residual,
   which gives the exact offset.

The index is a value of its own (``RankIndex``): texts of a task's slice share one,
so it takes about a byte for each unit, and slices are bounded in bytes.

The draws of a document come from the SHA-256 of "seed:id", so they depend on nothing
but its id, on any cluster.

Cases: a null text is empty; empty texts and texts that hold a sentinel stay plain;
a null id draws as an empty number; repeated rows get equal results; texts may be of
any length (one text may be a slice of its own); an empty table gives no rows; other
columns are ignored, whatever their names.  Bytes that are no valid UTF-8 stay as
they are, a code point beginning at each byte that doesn't continue another.
"""

from __future__ import annotations

import re
from hashlib import sha256
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.pieces import sliced

ERROR = 64                       # bytes; residuals fit a signed byte
PLAIN, PSM, SPM = "plain", "psm", "spm"
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
FIRST_RUN = 256                  # boundaries that a segment tries first; doubled while it lasts
SLICE_BYTES = 4 << 20
#: Units other than code points, as byte patterns that match left to right; each pattern covers every byte.
UNITS = {"words": re.compile(rb"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*|[\x20\x09-\x0D]+"), "lines": re.compile(rb"[^\n]*\n|[^\n]+")}


class RankIndex(NamedTuple):
    """Lines (first rank, first offset, slope) and a residual for each rank."""
    first: np.ndarray
    offset: np.ndarray
    slope: np.ndarray
    residual: np.ndarray

    def predict(self, ranks: np.ndarray) -> np.ndarray:
        k = np.searchsorted(self.first, ranks, "right") - 1
        return self.offset[k] + np.rint((ranks - self.first[k]) * self.slope[k]).astype(np.int64)

    def locate(self, ranks: np.ndarray) -> np.ndarray:
        """The exact offsets of these ranks."""
        return self.predict(ranks) + self.residual[ranks]


def fit(offsets: np.ndarray) -> RankIndex:
    """The index of ascending offsets, at least one."""
    first, start, slope, at, run = [], [], [], 0, FIRST_RUN
    while at < len(offsets):
        low, high, end = 0.0, np.inf, at + 1
        while end < len(offsets):
            part = offsets[end:end + run] - offsets[at]
            steps = np.arange(end - at, end - at + len(part))
            lows = np.maximum(np.maximum.accumulate((part - ERROR + 1) / steps), low)
            highs = np.minimum(np.minimum.accumulate((part + ERROR - 1) / steps), high)
            out = np.flatnonzero(lows > highs)
            if len(out):
                if out[0]:
                    low, high = lows[out[0] - 1], highs[out[0] - 1]
                end += int(out[0])
                run = max(FIRST_RUN, run // 2)
                break
            low, high, end, run = lows[-1], highs[-1], end + len(part), run * 2
        first.append(at)
        start.append(offsets[at])
        slope.append(0.0 if high == np.inf else (low + high) / 2)
        at = end
    index = RankIndex(np.array(first, np.int64), np.array(start, np.int64), np.array(slope), np.zeros(0, np.int8))
    return index._replace(residual=(offsets - index.predict(np.arange(len(offsets)))).astype(np.int8))


def boundaries(data: np.ndarray, ends: np.ndarray, unit: str = "chars") -> tuple[np.ndarray, np.ndarray]:
    """Of texts that lie one after another in ``data`` and end at ``ends``: the offsets
    at which units begin, with the end of all, and the rank of each text's begin."""
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    if unit == "chars":
        begin = (data & 0xC0) != 0x80
    else:
        begin, raw = np.zeros(len(data), bool), data.tobytes()
        for a, b in zip(starts.tolist(), ends.tolist()):
            begin[[a + m.start() for m in UNITS[unit].finditer(raw[a:b])]] = True
    begin[starts[starts < ends]] = True         # a text begins a unit, whatever its first byte
    offsets = np.append(np.flatnonzero(begin), len(data))
    return offsets, np.searchsorted(offsets, starts)


def draws(seed: str, key) -> tuple[int, int, int, int]:
    digest = sha256(f"{seed}:{'' if key is None else key}".encode()).digest()
    return tuple(int.from_bytes(digest[k:k + 4], "big") for k in (0, 4, 8, 12))


def order(form: str, prefix: bytes, middle: bytes, suffix: bytes) -> bytes:
    if form == PSM:
        return PREFIX + prefix + SUFFIX + suffix + MIDDLE + middle
    return SUFFIX + suffix + PREFIX + prefix + MIDDLE + middle


def restore(form: str, output: bytes) -> bytes:
    """The text of which this is the output."""
    if form == PLAIN:
        return output
    one, other = (PREFIX, SUFFIX) if form == PSM else (SUFFIX, PREFIX)
    a, b = output.index(other), output.index(MIDDLE)
    head, tail, middle = output[len(one):a], output[a + len(other):b], output[b + len(MIDDLE):]
    return head + middle + tail if form == PSM else tail + middle + head


def transform(texts: list[bytes], keys: list, rate: int, spm_rate: int, unit: str, seed: str) -> list[tuple]:
    """(units, form, units of the prefix, of the middle, output) of each text."""
    ends = np.cumsum([len(t) for t in texts])
    joined = b"".join(texts)
    offsets, ranks = boundaries(np.frombuffer(joined, np.uint8), ends, unit)
    index = fit(offsets)
    sizes = np.diff(np.append(ranks, len(offsets) - 1))
    out, cuts = [], []
    for text, key, n in zip(texts, keys, sizes.tolist()):
        h = draws(seed, key)
        a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
        plain = not text or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)) or h[2] % 100 >= rate
        out.append((n, PLAIN if plain else SPM if h[3] % 100 < spm_rate else PSM, a, b - a))
        cuts.append((a, b))
    places = index.locate((np.array(cuts, np.int64).reshape(-1, 2) + ranks[:, None]).ravel()).reshape(-1, 2)
    starts = ends - [len(t) for t in texts]
    done = []
    for text, (n, form, p, m), (a, b) in zip(texts, out, (places - starts[:, None]).tolist()):
        done.append((n, PLAIN, None, None, text) if form == PLAIN else
                    (n, form, p, m, order(form, text[:a], text[a:b], text[b:])))
    return done


def fill_in_middle(documents: DataFrame, rate: int = 90, spm_rate: int = 20, unit: str = "chars", seed: str = "1",
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, form, prefix_units, middle_units, output, restored) of every row: ``rate`` of
    a hundred texts are transformed, ``spm_rate`` of a hundred of these suffix first."""
    if unit != "chars" and unit not in UNITS:
        raise ValueError(f"unit is chars, {' or '.join(UNITS)}, not {unit}")
    kind = documents.schema[id_col].dataType.simpleString()
    docs = documents.select(F.col(id_col).alias("id"),
                            F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))

    def run(batches):
        for batch in batches:
            ids, at = batch.column("id"), 0
            for texts in sliced(batch.column("text").to_pylist(), SLICE_BYTES):
                keys = ids.slice(at, len(texts))
                at += len(texts)
                got = transform(texts, keys.to_pylist(), rate, spm_rate, unit, seed)
                n, form, prefix, middle, output = zip(*got)
                yield pa.RecordBatch.from_arrays([
                    keys, pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()),
                    pa.array(middle, pa.int64()), pa.array(output, pa.binary()),
                    pa.array([restore(f, o) for f, o in zip(form, output)], pa.binary())],
                    ["id", "n", "form", "prefix_units", "middle_units", "output", "restored"])

    made = docs.mapInArrow(run, f"id {kind}, n long, form string, prefix_units long, middle_units long, "
                                "output binary, restored binary")
    return made.select(F.col("id").alias(id_col), "n", "form", "prefix_units", "middle_units",
                       F.col("output").cast("string").alias("output"), F.col("restored").cast("string").alias("restored"))
