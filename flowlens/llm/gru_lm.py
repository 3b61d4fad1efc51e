"""LM scoring with a gated recurrent language model.

Words are lower-cased (A-Z); every text ends in an end token.  All texts whose
crc32(id) mod 10 is not 0 are learned from, all texts are scored, whole.

* Counts: every training token of the corpus, by one shuffle.
* Symbols: the ``FREQUENT`` most frequent tokens each have one; any other word
  has the symbol of its ending (``RARE`` symbols).
* Model: GRU over symbols.  The output is factored: a softmax over classes, then
  within a frequent class a softmax over its tokens, within a rare class the
  smoothed corpus counts (c + 0.1) / (N_r + 0.1 (V_r + 1)).  Output biases start
  at the corpus frequencies, so training starts from a unigram model.
* Training: truncated backpropagation in numpy over every training document, in
  ``ROUNDS`` rounds.  In a round every task starts from the same parameters and
  trains on its part; the parameters are averaged in Spark, weighted by tokens,
  in two levels, so the driver gets one parameter set (fixed size) a round.
* Scoring: the state is carried across windows from a document's first token to
  its end token, so the score is the log probability of the complete document.
  Some blocks' documents are scored side by side, so that a long one seldom runs alone.

Documents are kept as blocks of about ``BLOCK_TOKENS`` tokens or ``BLOCK_WORDS``
distinct words, whichever comes first: a block's distinct words, and each document's tokens as positions among them.  The counts of the
``COMMON`` most frequent tokens (a fixed number) are broadcast; all others reach a
block by a join on the word, with one row per block and distinct word; so no task
needs the whole vocabulary.

Cases: a null or empty text is the end token alone; texts may be of any length;
a null id is learned from; repeated rows are scored alike; an empty table gives
no rows; without training rows every count is 0; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
import pickle
from collections import Counter, defaultdict
from itertools import count, repeat
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.functions.vectors import one_thread
from flowlens.operators.store import materialize

END = b"\n"                       # no word holds it
FREQUENT, CLASSES, RARE = 1024, 32, 32
HIDDEN, STREAMS, WINDOW = 16, 384, 16
ROUNDS, RATE, WARM_UP, STRETCH, BURN_IN = 4, 0.009, 30, 1024, 32
LANES, JUDGED = 512, 8192         # documents scored side by side, and tokens judged at once
POOL_TOKENS = 3_000_000           # of blocks that are scored together
BLOCK_TOKENS, BLOCK_WORDS = 1_000_000, 45_000   # positions among a block's words mostly fit 16 bits
COMMON = 100_000                  # so many tokens' counts are broadcast; the others' are joined
SMOOTH = 0.1


def tokens_of(text: str | bytes) -> list[bytes]:
    """Words without space and U+0009..U+000D, A-Z lower-cased, and the end token."""
    words = (text if isinstance(text, bytes) else text.encode("utf-8", "surrogatepass")).lower().split()
    words.append(END)
    return words


def rare_class(word: bytes) -> int:
    return crc32(word[-3:]) % RARE


class Vocabulary:
    """Symbols and classes.  Frequent symbols are numbered class by class; classes
    hold about equal shares of the square roots of counts."""

    def __init__(self, top: list[tuple[bytes, int]], rare_total: np.ndarray, rare_kinds: np.ndarray):
        root = np.sqrt([c for _, c in top])
        share = np.cumsum(root) / max(root.sum(), 1e-9) if len(top) else root
        cls = np.minimum((share * CLASSES).astype(np.int64), CLASSES - 1)
        self.first = np.searchsorted(cls, np.arange(CLASSES + 1))
        self.symbol = {w: n for n, (w, _) in enumerate(top)}
        self.n = len(top)
        self.cls = np.concatenate([cls, CLASSES + np.arange(RARE)])
        self.count = np.array([c for _, c in top], np.float64)
        self.rare_norm = np.log10(rare_total + SMOOTH * (rare_kinds + 1))
        self.rare_total = rare_total

    def of(self, word: bytes) -> int:
        got = self.symbol.get(word)
        return self.n + rare_class(word) if got is None else got


class Gru:
    """Parameters and passes of the network."""

    def __init__(self, vocabulary: Vocabulary, seed: int = 1):
        rng = np.random.default_rng(seed)
        v, h = vocabulary, HIDDEN
        small = lambda *s: (rng.standard_normal(s) * 0.1).astype(np.float32)
        mass = np.concatenate([[v.count[a:b].sum() for a, b in zip(v.first, v.first[1:])], v.rare_total])
        self.v = v
        self.p = {"e": small(v.n + RARE, 3 * h), "u": small(h, 3 * h), "wc": small(h, CLASSES + RARE) * 0,
                  "bc": np.log(mass + 1).astype(np.float32), "wi": small(v.n, h) * 0,
                  "bi": np.log(v.count + 1).astype(np.float32)}

    def steps(self, x: np.ndarray, keep: np.ndarray | None, h: np.ndarray, saved: list | None = None) -> np.ndarray:
        """States (time, hidden, stream) after each of x's rows (time) for its columns
        (streams); ``keep`` is 0 where a document begins.  Streams are the last axis
        everywhere, so that numpy works on long rows."""
        k = 2 * HIDDEN
        g = np.take(np.ascontiguousarray(self.p["e"].T), x.ravel(), axis=1).reshape(3 * HIDDEN, *x.shape)
        u = np.ascontiguousarray(self.p["u"].T)
        out = np.empty((x.shape[0], HIDDEN, x.shape[1]), np.float32)
        a = np.empty((3 * HIDDEN, x.shape[1]), np.float32)
        for t in range(len(x)):
            if keep is not None:
                h = h * keep[t]
            np.matmul(u, h, out=a)
            zr = g[:k, t] + a[:k]
            np.negative(zr, out=zr)
            np.exp(zr, out=zr)
            zr += 1
            np.reciprocal(zr, out=zr)
            z, r = zr[:HIDDEN], zr[HIDDEN:]
            n = r * a[k:]
            n += g[k:, t]
            np.tanh(n, out=n)
            if saved is not None:
                saved.append((h, z, r, a[k:].copy(), n))
            h = np.subtract(h, n, out=out[t])
            h *= z
            h += n
        return out

    def outputs(self, states: np.ndarray, targets: np.ndarray, grads: dict | None = None):
        """Natural log probabilities of the targets after ``states`` (hidden, row), without
        the counts of rare classes; with ``grads`` also the gradient with respect to the
        states.  Rows are taken in order of class, so every class's rows lie together."""
        p, v = self.p, self.v
        order = np.argsort(v.cls[targets].astype(np.int8), kind="stable")
        states, targets = np.take(states, order, axis=1), targets[order]
        kind, at = v.cls[targets], np.arange(len(targets))
        logits = p["wc"].T @ states
        logits += p["bc"][:, None]
        logits -= logits.max(axis=0)
        logp = logits[kind, at]
        np.exp(logits, out=logits)
        total = logits.sum(axis=0)
        logp -= np.log(total)
        back = None
        if grads is not None:
            logits /= total
            logits[kind, at] -= 1
            grads["wc"], grads["bc"] = states @ logits.T, logits.sum(axis=1)
            grads["wi"], grads["bi"] = np.zeros_like(p["wi"]), np.zeros_like(p["bi"])
            back = p["wc"] @ logits
        edges = np.searchsorted(kind, np.arange(CLASSES + 1))
        for c in range(CLASSES):
            rows, s = slice(edges[c], edges[c + 1]), slice(v.first[c], v.first[c + 1])
            if edges[c] == edges[c + 1] or s.stop - s.start < 2:
                continue
            hs, own = states[:, rows], targets[rows] - s.start
            i = at[:len(own)]
            inner = p["wi"][s] @ hs
            inner += p["bi"][s, None]
            inner -= inner.max(axis=0)
            logp[rows] += inner[own, i]
            np.exp(inner, out=inner)
            total = inner.sum(axis=0)
            logp[rows] -= np.log(total)
            if grads is not None:
                inner /= total
                inner[own, i] -= 1
                grads["wi"][s], grads["bi"][s] = inner @ hs.T, inner.sum(axis=1)
                back[:, rows] += p["wi"][s].T @ inner
        out = np.empty_like(logp)
        out[order] = logp
        if grads is None:
            return out, None
        whole = np.empty_like(back)
        whole[:, order] = back
        return out, whole

    def gradients(self, x, y, keep, real, h):
        """Gradients of a window's mean loss, and the state after it."""
        saved, grads = [], {}
        states = self.steps(x, keep, h, saved)
        flat = np.flatnonzero(real.ravel())
        steps, streams = x.shape
        lined = states.transpose(1, 0, 2).reshape(HIDDEN, -1)
        if len(flat) == x.size:
            full = self.outputs(lined, y.ravel(), grads)[1]
        else:
            full = np.zeros((HIDDEN, x.size), np.float32)
            full[:, flat] = self.outputs(np.take(lined, flat, axis=1), y.ravel()[flat], grads)[1]
        full = full.reshape(HIDDEN, steps, streams)
        u, k = self.p["u"], 2 * HIDDEN
        gates, inputs = np.empty((3 * HIDDEN, steps, streams), np.float32), np.empty((HIDDEN, steps, streams), np.float32)
        ge = np.empty_like(gates)
        dh = np.zeros_like(h)
        for t in range(steps - 1, -1, -1):
            h0, z, r, un, n = saved[t]
            inputs[:, t] = h0
            dh = dh + full[:, t]
            rest = 1 - z
            dn = n * n
            np.subtract(1, dn, out=dn)
            dn *= dh
            dn *= rest
            dz = h0 - n
            dz *= z
            dz *= dh
            dz *= rest
            dr = dn * un
            dr *= r
            dr *= 1 - r
            ge[:HIDDEN, t], ge[HIDDEN:k, t], ge[k:, t] = dz, dr, dn
            da = np.concatenate([dz, dr, dn * r])
            gates[:, t] = da
            dh *= z
            dh += u @ da
            dh *= keep[t]
        grads["u"] = inputs.reshape(HIDDEN, -1) @ gates.reshape(3 * HIDDEN, -1).T
        flat_x = x.ravel()
        order = np.argsort(flat_x.astype(np.uint16) if len(self.p["e"]) <= 65_536 else flat_x, kind="stable")
        symbols, starts = np.unique(flat_x[order], return_index=True)
        grads["e"] = np.zeros_like(self.p["e"])
        grads["e"][symbols] = np.add.reduceat(np.take(ge.reshape(3 * HIDDEN, -1), order, axis=1), starts, axis=1).T
        return {name: g / max(len(flat), 1) for name, g in grads.items()}, states[-1]

    def train(self, docs: list[np.ndarray], adam: dict) -> None:
        """One pass over documents (symbols, the end symbol last), laid one after another
        into streams of about equal length.  Longer ones go in stretches of ``STRETCH``
        tokens; a later stretch's state comes from the ``BURN_IN`` tokens before it."""
        if not docs:
            return
        end = self.v.symbol.get(END, self.v.n)
        sizes = list(map(len, docs))
        lanes = lay(sizes, max(1, min(STREAMS, sum(sizes) // STRETCH)), STRETCH)    # few tokens, few streams
        # a later stretch of a document goes first through the tokens before it, unjudged
        lanes = [[(d, max(0, a - BURN_IN), a, b) for d, a, b in lane] for lane in lanes]
        lanes.sort(key=lambda lane: -sum(b - a0 for _, a0, _, b in lane))
        fill = [sum(b - a0 for _, a0, _, b in lane) for lane in lanes]
        size = fill[0]
        y = np.zeros((len(lanes), size), np.int64)
        x = np.full((len(lanes), size), end, np.int64)
        new, real = np.zeros((len(lanes), size), bool), np.zeros((len(lanes), size), bool)
        for k, lane in enumerate(lanes):
            at = 0
            for d, a0, a, b in lane:
                part = docs[d][a0:b]
                y[k, at:at + b - a0] = part
                x[k, at + 1:at + b - a0] = part[:-1]
                if a0:
                    x[k, at] = docs[d][a0 - 1]
                new[k, at] = True
                real[k, at + a - a0:at + b - a0] = True
                at += b - a0
        x, y, real, keep = x.T, y.T, real.T, (~new).T.astype(np.float32)
        h = np.zeros((HIDDEN, len(lanes)), np.float32)
        for at in range(0, size, WINDOW):
            live = sum(f > at for f in fill)
            s = slice(at, at + WINDOW), slice(live)
            grads, h = self.gradients(x[s], y[s], keep[s], real[s], h[:, :live])
            adam["t"] = t = adam.get("t", 0) + 1
            share = min(1.0, 4 * live / STREAMS)  # few streams, a noisier gradient: a smaller step
            rate = RATE * min(1.0, t / WARM_UP) * share * math.sqrt(1 - 0.99 ** t) / (1 - 0.9 ** t)
            for name, g in grads.items():
                if name not in adam:
                    adam[name] = np.zeros_like(g), np.zeros_like(g)
                m, q = adam[name]
                m *= 0.9
                m += 0.1 * g
                np.multiply(g, g, out=g)
                g *= 0.01
                q *= 0.99
                q += g
                np.sqrt(q, out=g)
                g += 1e-6
                np.divide(m, g, out=g)
                g *= rate
                self.p[name] -= g

    def score(self, docs: list[np.ndarray]) -> np.ndarray:
        """log10 probability of each document's symbols; the state is carried from its first
        window to its last.  Documents follow one another in as many streams as the
        longest one can share its time with."""
        sizes = list(map(len, docs))
        if not docs:
            return np.zeros(0)
        end = self.v.symbol.get(END, self.v.n)
        lanes = lay(sizes, max(1, min(LANES, sum(sizes) // max(sizes) + 1)))
        fill = np.array([sum(b - a for _, a, b in lane) for lane in lanes])
        size = int(fill.max())
        y, x = np.zeros((len(lanes), size), np.uint16), np.full((len(lanes), size), end, np.uint16)
        keep = np.ones((len(lanes), size), np.float32)
        for k, lane in enumerate(lanes):
            at = 0
            for d, a, b in lane:
                y[k, at:at + b] = docs[d]
                x[k, at + 1:at + b] = docs[d][:-1]
                keep[k, at] = 0
                at += b
        logp = np.zeros((len(lanes), size), np.float32)
        h = np.zeros((HIDDEN, len(lanes)), np.float32)
        waiting: list[tuple] = []       # windows, and the states after their inputs

        def judge():
            states = np.concatenate([w[1].transpose(1, 0, 2).reshape(HIDDEN, -1) for w in waiting], axis=1)
            found = self.outputs(states, np.concatenate([y[w[0]].T.ravel() for w in waiting]).astype(np.int64))[0]
            for (s, own), a in zip(waiting, np.cumsum([0] + [w[1].shape[0] * w[1].shape[2] for w in waiting])):
                logp[s] = found[a:a + own.shape[0] * own.shape[2]].reshape(own.shape[0], -1).T
            waiting.clear()

        for at in range(0, size, WINDOW):
            live = int(np.searchsorted(-fill, -at, "left"))
            s = slice(live), slice(at, at + WINDOW)
            states = self.steps(x[s].T, keep[s].T, h[:, :live])
            h = states[-1]
            waiting.append((s, states))
            if sum(w[1].shape[0] * w[1].shape[2] for w in waiting) >= JUDGED:
                judge()
        if waiting:
            judge()
        out = np.empty(len(docs))
        for k, lane in enumerate(lanes):
            starts = np.cumsum([0] + [b for _, _, b in lane[:-1]])
            out[[d for d, _, _ in lane]] = np.add.reduceat(logp[k, :fill[k]].astype(np.float64), starts)
        return out / math.log(10)


def lay(sizes: list[int], lanes: int, stretch: int | None = None) -> list[list[tuple[int, int, int]]]:
    """Documents, or stretches of them, as (number, from, to) dealt to lanes, longest
    first to the shortest lane; the fullest lane first, empty ones dropped."""
    step = stretch or max(sizes)
    parts = sorted(((min(step, n - a), d, a) for d, n in enumerate(sizes) for a in range(0, n, step)), key=lambda p: (-p[0], p[1], p[2]))
    heap, out = [(0, k) for k in range(lanes)], [[] for _ in range(lanes)]
    for n, d, a in parts:
        filled, k = heapq.heappop(heap)
        out[k].append((d, a, a + n))
        heapq.heappush(heap, (filled + n, k))
    return sorted((lane for lane in out if lane), key=lambda lane: -sum(b - a for _, a, b in lane))


def count_words(docs: DataFrame) -> DataFrame:
    """(word, c): how often each token occurs in training documents."""
    def run(batches):
        counts: Counter[bytes] = Counter()

        def rows():
            out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()),
                                              pa.array(list(counts.values()), pa.int64())], ["word", "c"])
            counts.clear()
            return out

        for batch in batches:
            for text in batch.column("text").to_pylist():
                counts.update(tokens_of(text))
                if len(counts) > 1_000_000:
                    yield rows()
        if counts:
            yield rows()

    found = docs.where("not held_out").select("text").mapInArrow(run, "word binary, c long")
    return found.groupBy("word").agg(F.sum("c").alias("c"))


def most_frequent(counts: DataFrame, n: int) -> DataFrame:
    """The n most frequent words.  A histogram of the counts' logarithms tells first how
    high a count is needed, so that tasks send few words besides."""
    level = F.floor(F.log2("c") * 16)
    seen, least = 0, None
    for r in sorted(counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("k")).collect(), reverse=True):
        seen, least = seen + r["k"], r["level"]
        if seen >= n:
            break
    return counts.where(level >= (least or 0)).orderBy(F.desc("c"), "word").limit(n)


def make_blocks(docs: DataFrame, vocabulary, common) -> DataFrame:
    """One row per block: the symbols of its distinct words, their counts if they
    are common, the others with their positions, its documents' ids, lengths and
    tokens (positions among the words)."""
    kind = docs.schema["id"].dataType.simpleString()
    names = ["block", "words", "places", "counts", "symbols", "ids", "held_out", "sizes", "tokens"]

    def run(batches):
        v, number, of_common = vocabulary.value, 0, common.value
        base = TaskContext.get().partitionId() << 32
        place: dict[bytes, int] = defaultdict(count().__next__)     # a new word has the next number
        ids, held, sizes, parts, total, held_type = [], [], [], [], 0, pa.int64()

        def row():
            words = list(place)
            symbols = np.fromiter(map(v.symbol.get, words, repeat(-1)), np.int32, len(words))
            rare = np.flatnonzero(symbols < 0)
            symbols[rare] = v.n + np.fromiter(map(crc32, [words[k][-3:] for k in rare.tolist()]), np.uint32, len(rare)) % RARE
            symbols = symbols.astype(np.uint16)
            counts = np.fromiter(map(of_common.get, words, repeat(0)), np.int64, len(words))
            other = np.flatnonzero(counts == 0).tolist()
            return pa.RecordBatch.from_arrays([
                pa.array([base + number], pa.int64()), pa.array([[words[k] for k in other]], pa.list_(pa.binary())),
                pa.array([other], pa.list_(pa.int32())), pa.array([counts.tobytes()], pa.binary()),
                pa.array([symbols.tobytes()], pa.binary()), pa.array([ids], pa.list_(held_type)),
                pa.array([held], pa.list_(pa.bool_())), pa.array([sizes], pa.list_(pa.int32())),
                pa.array([np.concatenate(parts).astype("<u2" if len(place) <= 65_536 else "<u4").tobytes()], pa.binary())],
                names)

        for batch in batches:
            held_type = batch.schema.field("id").type
            for key, out, text in zip(*(batch.column(c).to_pylist() for c in ("id", "held_out", "text"))):
                words = tokens_of(text)
                parts.append(np.fromiter(map(place.__getitem__, words), "<u4", len(words)))
                ids.append(key)
                held.append(out)
                sizes.append(len(words))
                total += len(words)
                if total >= BLOCK_TOKENS or len(place) >= BLOCK_WORDS:
                    yield row()
                    place, number, total = defaultdict(count().__next__), number + 1, 0
                    ids, held, sizes, parts = [], [], [], []
        if ids:
            yield row()

    return docs.select("id", "held_out", "text").mapInArrow(
        run, f"block long, words array<binary>, places array<int>, counts binary, symbols binary, ids array<{kind}>, held_out array<boolean>, "
             "sizes array<int>, tokens binary")


def _places(tokens: bytes, sizes) -> np.ndarray:
    """A block's tokens: 16-bit numbers, or 32-bit ones where it has too many words."""
    return np.frombuffer(tokens, "<u2" if len(tokens) == 2 * int(np.sum(sizes)) else "<u4")


def _documents(symbols: bytes, sizes, tokens: bytes) -> list[np.ndarray]:
    of = np.frombuffer(symbols, np.uint16)
    return np.split(of[_places(tokens, sizes)], np.cumsum(sizes)[:-1])


def train_round(blocks: DataFrame, shared) -> dict | None:
    """Average, weighted by tokens, of the parameters that each task reaches."""
    def run(batches):
        one_thread()
        gru, adam, seen, waiting, size = pickle.loads(shared.value), {}, 0, [], 0
        for batch in batches:
            for r in batch.to_pylist():
                docs = _documents(r["symbols"], r["sizes"], r["tokens"])
                own = [d for d, out in zip(docs, r["held_out"]) if not out]
                waiting += own
                size += sum(map(len, own))
                if size >= BLOCK_TOKENS:    # enough to fill the streams evenly
                    gru.train(waiting, adam)
                    seen, waiting, size = seen + size, [], 0
        gru.train(waiting, adam)
        seen += size
        if seen:
            for name, value in gru.p.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name]), pa.array([float(seen)]), pa.array([TaskContext.get().partitionId() % 64]),
                     pa.array([(value.astype(np.float64) * seen).tobytes()], pa.binary())],
                    ["name", "weight", "part", "total"])

    def add(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("weight", kind="stable")
        total = sum(np.frombuffer(x, np.float64) for x in part["total"])
        return part.head(1).assign(weight=part["weight"].sum(), total=[total.tobytes()])

    schema = "name string, weight double, part long, total binary"
    sums = (blocks.select("symbols", "held_out", "sizes", "tokens").mapInArrow(run, schema)
            .groupBy("name", "part").applyInPandas(add, schema).groupBy("name").applyInPandas(add, schema).collect())
    return {r["name"]: np.frombuffer(r["total"], np.float64) / r["weight"] for r in sums} or None


def score_documents(documents: DataFrame, rounds: int = ROUNDS, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row."""
    spark = documents.sparkSession
    held = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 10 == 0, F.lit(False))
    docs = documents.select(F.col(id_col).alias("id"), held.alias("held_out"),
                            F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    counts = materialize(count_words(docs), "lm-counts")
    sums = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
    n_train, kinds = sums["n"] or 0, sums["v"]
    common = [(bytes(r["word"]), r["c"]) for r in most_frequent(counts, COMMON).collect()]
    top = common[:FREQUENT]
    ending = F.crc32(F.substring("word", -3, 3)) % RARE
    rare_total, rare_kinds = np.zeros(RARE), np.zeros(RARE)
    for r in counts.groupBy(ending.alias("r")).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("k")).collect():
        rare_total[r["r"]], rare_kinds[r["r"]] = r["c"], r["k"]
    for w, c in top:   # frequent tokens are not in the rare classes
        rare_total[rare_class(w)] -= c
        rare_kinds[rare_class(w)] -= 1
    vocabulary = Vocabulary(top, rare_total, rare_kinds)

    share = spark.sparkContext.broadcast
    blocks = materialize(make_blocks(docs, share(vocabulary), share(dict(common))), "lm-blocks")
    gru = Gru(vocabulary)
    for k in range(rounds):
        # a partition's blocks take turns
        turn = (F.shiftright("block", 32) + F.col("block").bitwiseAND(0xFFFFFFFF)) % rounds == k
        got = train_round(blocks.where(turn), spark.sparkContext.broadcast(pickle.dumps(gru)))
        if got:
            gru.p = {name: got[name].astype(np.float32).reshape(p.shape) for name, p in gru.p.items()}

    words = (blocks.select("block", F.explode(F.arrays_zip("places", "words")).alias("z"))
             .select("block", F.col("z.places").alias("place"), F.col("z.words").alias("word")))
    known = (words.join(counts, "word").groupBy("block")  # at most BLOCK_TOKENS rows a block
             .agg(F.collect_list(F.struct("place", "c")).alias("known")))
    shared = spark.sparkContext.broadcast(pickle.dumps(gru))
    norm = math.log10(n_train + SMOOTH * (kinds + 1))

    def judged(model, pool):
        """Rows of some blocks; their documents are scored side by side."""
        docs = [d for r in pool for d in _documents(r["symbols"], r["sizes"], r["tokens"])]
        scores, at = model.score(docs), 0
        for r in pool:
            sizes, of = r["sizes"], np.frombuffer(r["symbols"], np.uint16).astype(np.int64)
            starts = np.cumsum(sizes) - sizes
            tokens, c = _places(r["tokens"], sizes), r["c"]
            logc = np.log10(c + SMOOTH)
            rare = np.where(of >= model.v.n, logc - model.v.rare_norm[np.maximum(of - model.v.n, 0)], 0.0)
            per = lambda x: np.add.reduceat(x[tokens], starts)  # noqa: E731, B023
            score = scores[at:at + len(sizes)] + per(rare)
            at += len(sizes)
            yield pa.RecordBatch.from_arrays([
                r["ids"], r["held_out"], pa.array(sizes), pa.array(per((c > 0).astype(np.int64))),
                pa.array(per(logc) - sizes * norm), pa.array(score)],
                ["id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    def run(batches):
        one_thread()
        model, pool, size = pickle.loads(shared.value), [], 0
        for batch in batches:
            for k in range(batch.num_rows):
                r = {c: batch.column(c)[k] for c in batch.schema.names}
                c = np.frombuffer(r["counts"].as_py(), np.int64).astype(np.float64)
                if r["known"].is_valid:
                    pairs = r["known"].values
                    c[pairs.field("place").to_numpy()] = pairs.field("c").to_numpy()
                pool.append({"symbols": r["symbols"].as_py(), "sizes": np.array(r["sizes"].as_py(), np.int64), "tokens": r["tokens"].as_py(),
                             "c": c, "ids": r["ids"].values, "held_out": r["held_out"].values})
                size += int(pool[-1]["sizes"].sum())
                if size >= POOL_TOKENS:
                    yield from judged(model, pool)
                    pool, size = [], 0
        if pool:
            yield from judged(model, pool)

    kind = docs.schema["id"].dataType.simpleString()
    out = (blocks.select("block", "counts", "symbols", "ids", "held_out", "sizes", "tokens").join(known, "block", "left").drop("block")
           .mapInArrow(run, f"id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double"))
    return out.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known",
                      F.lit(n_train).cast("long").alias("train_tokens"), "base_score", "score")
