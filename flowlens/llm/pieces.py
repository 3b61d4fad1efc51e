"""Reading a BPE piece model, and splitting texts into independent units."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
CACHE_UNITS, CACHE_CHARS = 500_000, 64
SLICE_CHARS = 1_000_000


class PieceModel(NamedTuple):
    pieces: list[str]
    scores: list[float]
    kinds: list[int]
    byte_ids: list[int]     #: id of the piece of each byte
    dummy_prefix: bool


class KeyMap:
    """Fixed table from 64-bit keys (not negative) to a row number, looked up for
    whole arrays at once: open addressing at a load of at most a quarter."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(4 * max(len(keys), 1) - 1).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.rows = np.full(1 << self.bits, -1, np.int32)
        left = np.arange(len(keys))
        at = self._slot(keys)
        while len(left):
            free = self.keys[at] < 0
            _, first = np.unique(at, return_index=True)
            put = first[free[first]]
            self.keys[at[put]] = keys[left[put]]
            self.rows[at[put]] = left[put]
            rest = np.ones(len(left), bool)
            rest[put] = False
            left, at = left[rest], (at[rest] + 1) & (len(self.keys) - 1)

    def _slot(self, keys):
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, -1 where it has none."""
        at = self._slot(keys)
        seen = self.keys[at]
        rows = self.rows[at]
        odd = np.flatnonzero((seen != keys) & (seen >= 0))
        rows[seen != keys] = -1
        at = at[odd]
        while len(odd):
            at = (at + 1) & (len(self.keys) - 1)
            seen = self.keys[at]
            hit = seen == keys[odd]
            rows[odd[hit]] = self.rows[at[hit]]
            more = ~hit & (seen >= 0)
            odd, at = odd[more], at[more]
        return rows


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of a protocol-buffer message."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(kind) or varint()
            yield key >> 3, data[at:at + n]
            at += n


def read_model(path: str) -> PieceModel:
    """Pieces of a BPE model with byte fallback and without a character map;
    anything else is refused, since other models segment by other rules."""
    with open(path, "rb") as f:
        parts = list(_fields(f.read()))
    rows = [dict(_fields(v)) for k, v in parts if k == 1]
    trainer = dict(_fields(next(v for k, v in parts if k == 2)))
    normalizer = dict(_fields(next(v for k, v in parts if k == 3)))
    kinds = [r.get(3, NORMAL) for r in rows]
    if trainer.get(3) != 2 or not trainer.get(35) or trainer.get(24):
        raise ValueError("a BPE model with byte fallback and space as a prefix is needed")
    if normalizer.get(2) or normalizer.get(4, 1) or not normalizer.get(5, 1) or {USER, UNUSED} & set(kinds):
        raise ValueError("character maps, space folding and user-defined pieces are not supported")
    pieces = [r[1].decode() for r in rows]
    at = {p: i for i, p in enumerate(pieces)}
    if any(SPACE in p.lstrip(SPACE) for p, k in zip(pieces, kinds) if k == NORMAL):
        raise ValueError("a piece spans words")
    return PieceModel(pieces, [struct.unpack("<f", r.get(2, b"\0\0\0\0"))[0] for r in rows], kinds,
                      [at[f"<0x{b:02X}>"] for b in range(256)], bool(normalizer.get(3, 1)))


def unit_keys(text: str, dummy_prefix: bool = True) -> list[str]:
    """The text's units, each without its first space mark.  A unit is a run of
    space marks and what follows up to the next one; no piece crosses units."""
    if not text:
        return []
    if dummy_prefix and text[0] != " " and "  " not in text and SPACE not in text:
        return text.split(" ")
    text = (SPACE if dummy_prefix else "") + text.replace(" ", SPACE)
    return [u[1:] if u[0] == SPACE else "\0" + u for u in re.findall(f"{SPACE}+[^{SPACE}]*|^[^{SPACE}]+", text)]


def unit_text(key: str, dummy_prefix: bool = True) -> str:
    return key[1:] if not dummy_prefix and key[:1] == "\0" else SPACE + key


def sliced(texts: list[str], chars: int = SLICE_CHARS) -> Iterator[list[str]]:
    """Neighbouring texts together, about ``chars`` at a time (a longer text alone)."""
    part, size = [], 0
    for t in texts:
        if part and size + len(t) > chars:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t)
    if part:
        yield part


class UnitCache(dict):
    """What ``solve`` gives for units, kept for short units up to a count."""

    def __init__(self, solve):
        super().__init__()
        self.solve = solve

    def values(self, keys: list[str]) -> list:
        """What ``solve`` gives for each of these units."""
        if len(self) > CACHE_UNITS:
            self.clear()
        got = list(map(self.get, keys))
        gaps = [i for i, v in enumerate(got) if v is None]
        if gaps:
            new = sorted({keys[i] for i in gaps}, key=len)
            found = dict(zip(new, self.solve(new)))
            for i in gaps:
                got[i] = found[keys[i]]
            self.update(found if len(new[-1]) <= CACHE_CHARS else
                        {k: v for k, v in found.items() if len(k) <= CACHE_CHARS})
        return got
