"""Source divergence audit by Gustavson row accumulation.

How far do a language's sources differ in the terms they use?  Terms are runs of
letters (A-Z in lower case) and of characters beyond ASCII.  A language keeps the
terms that at least ``least_documents`` of its documents hold.  A group (language,
source) gives a kept term of count c the smoothed share, in parts of ``SCALE``,
p = 1 + floor(SCALE (c + 5) / (N + 5 V)), N the group's kept occurrences, V the
language's kept terms.  The divergence of two groups is the sum of |p - p'| over all
kept terms, whether they occur or not.

1. Terms are counted per task and group before the one shuffle by (language, source,
   term); a term's documents are counted along.
2. Every language's kept terms are dealt to blocks by hash, about ``BLOCK_POSTINGS``
   (source, term) postings each, so no task holds a language or a source.  A block is
   a term-major index: each term's postings, by source.
3. Row by row: a source scatters its terms through the index into a dense accumulator
   with one slot per peer.  Posting pairs are never rows; a block gives one array a
   source, and arrays are added up over the blocks.
4. Terms that one or both sources lack have the baseline b = p(0).  A row starts as if
   no term were shared: its own terms against each peer's baseline (by binary search
   in the sorted shares and their sums).  A shared term adds
   |p - p'| - |p - b'| - |b - p'| + |b - b'|; terms that neither holds add |b - b'|.

All arithmetic is on integers and exact: quotients by long division in base 1000,
sums below 2^63 as long as a language keeps fewer than 9 * 10^9 terms.

Cases: a null text, language or source is ''; a text may be of any length or hold no
term; a group without terms has baselines alone; a language without kept terms has
divergences of 0 and no term rows; repeated rows count each; an empty table gives no
rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlens.operators.store import materialize

SCALE, SMOOTH = 1_000_000_000, 5
LEAST_DOCUMENTS, TOP_TERMS = 30, 50
BLOCK_POSTINGS = 100_000
TASK_TERMS = 400_000            # (group, term) counts that a task holds before it hands them on
GATHER = 1_000_000              # postings that a row reads at once
CHUNK = 1 << 20                 # bytes of a text that are split at once
#: Letters to lower case, bytes beyond ASCII as they are, all else a space.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: bytes):
    """Lists of a text's terms, about ``CHUNK`` bytes at a time."""
    data, at = text.translate(TERM_BYTES), 0
    while at < len(data):
        end = data.find(b" ", at + CHUNK)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def count_terms(docs: DataFrame) -> DataFrame:
    """(lang, source, term, c, d): occurrences and documents of each group's terms."""
    def run(batches):
        counts: dict[tuple, list] = {}
        held = 0

        def rows():
            for (lang, source), (c, d) in counts.items():
                yield pa.RecordBatch.from_arrays([
                    pa.array([lang] * len(c), pa.string()), pa.array([source] * len(c), pa.string()),
                    pa.array(list(c), pa.binary()), pa.array(list(c.values()), pa.int64()),
                    pa.array([d[t] for t in c], pa.int64())], ["lang", "source", "term", "c", "d"])
            counts.clear()

        for batch in batches:
            for lang, source, text in zip(*(batch.column(k).to_pylist() for k in ("lang", "source", "text"))):
                c, d = counts.setdefault((lang, source), (Counter(), Counter()))
                held -= len(c)
                seen: set[bytes] = set()
                for terms in terms_of(text):
                    c.update(terms)
                    seen.update(terms)
                d.update(seen)
                held += len(c)
                if held >= TASK_TERMS:
                    yield from rows()
                    held = 0
        yield from rows()

    found = (docs.withColumn("text", F.col("text").cast("binary"))
             .mapInArrow(run, "lang string, source string, term binary, c long, d long"))
    return found.groupBy("lang", "source", "term").agg(F.sum("c").alias("c"), F.sum("d").alias("d"))


def share(count, total, kinds):
    """1 + floor(SCALE (count + 5) / (total + 5 kinds)) of columns, exactly; 1 where kinds
    is 0.  Long division, a digit of base 1000 at a time: every product is below 2^63."""
    div = lambda a, b: F.call_function("div", a, b)
    low = F.greatest(total + SMOOTH * kinds, F.lit(1))
    quotient, rest = div(count + SMOOTH, low), (count + SMOOTH) % low
    for _ in range(3):
        quotient, rest = quotient * 1000 + div(rest * 1000, low), (rest * 1000) % low
    return F.when(kinds > 0, quotient + 1).otherwise(F.lit(1)).cast("long")


def accumulate(term: np.ndarray, source: np.ndarray, p: np.ndarray, base: np.ndarray, kinds: int, every: bool):
    """Yields (source, array with a slot per peer) of a block's postings.  ``base`` is each
    source's p(0).  Added over the blocks and over both directions of a pair, the slots
    give its divergence.  ``kinds``, the language's kept terms, is given to one block
    alone, and 0 to others; with ``every`` sources without postings give a row too."""
    order = np.lexsort((source, term))
    source, p = source[order], p[order]
    _, first, size = np.unique(term[order], return_index=True, return_counts=True)
    end = np.repeat(first + size, size)                 # where each posting's term ends
    rows = np.argsort(source, kind="stable")            # the same postings by source
    edges = np.searchsorted(source[rows], np.arange(len(base) + 1))
    for g in range(len(base)):
        mine = rows[edges[g]:edges[g + 1]]
        if not len(mine) and not every:
            continue
        own = np.sort(p[mine])
        below = np.concatenate([[0], np.cumsum(own)])
        k = np.searchsorted(own, base, "right")
        gap = np.abs(base - base[g])
        acc = base * (2 * k - len(own)) + below[-1] - 2 * below[k] - len(own) * gap
        acc[g + 1:] += kinds * gap[g + 1:]
        reach = end[mine] - mine - 1                    # postings of higher sources in the same term
        cut = np.cumsum(reach) // GATHER
        for part in np.split(np.arange(len(mine)), np.flatnonzero(np.diff(cut)) + 1):
            n = reach[part]
            total = int(n.sum())
            if not total:
                continue
            at = np.arange(total) - np.repeat(np.cumsum(n) - n, n) + np.repeat(mine[part] + 1, n)
            peer, theirs, ours = source[at], p[at], np.repeat(p[mine[part]], n)
            np.add.at(acc, peer, np.abs(ours - theirs) - np.abs(ours - base[peer]) - np.abs(base[g] - theirs) + gap[peer])
        yield g, acc


def runs(batches, keys: list[str]):
    """(key, table) of neighbouring rows with equal integer keys, across batches."""
    at, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        values = np.stack([batch.column(k).to_numpy() for k in keys], axis=1)
        starts = np.concatenate([[0], np.flatnonzero((values[1:] != values[:-1]).any(axis=1)) + 1, [len(values)]])
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
            key = tuple(values[a].tolist())
            if key != at and held:
                yield at, pa.Table.from_batches(held)
                held = []
            at = key
            held.append(batch.slice(a, b - a))
    if held:
        yield at, pa.Table.from_batches(held)


def audit(documents: DataFrame, least_documents: int = LEAST_DOCUMENTS, top_terms: int = TOP_TERMS,
          text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank): every group's divergence from each other
    source of its language (part ``pair``) and the ``top_terms`` terms that it holds above
    the language's share (part ``term``), by falling value."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    docs = documents.select(blank(lang_col).alias("lang"), blank(source_col).alias("source"), blank(text_col).alias("text"))
    counts = materialize(count_terms(docs), "divergence-counts")
    kept = (counts.groupBy("lang", "term").agg(F.sum("d").alias("d"), F.sum("c").alias("lang_c"), F.count(F.lit(1)).alias("k"))
            .where(F.col("d") >= least_documents).drop("d").withColumn("term_id", F.monotonically_increasing_id()))
    kept = materialize(kept, "divergence-terms")
    postings = materialize(counts.drop("d").join(kept.drop("k"), ["lang", "term"]), "divergence-postings")

    every = docs.select("lang", "source").distinct()
    own = postings.groupBy("lang", "source").agg(F.sum("c").alias("n"))
    kinds = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("lang_c").alias("lang_n"), F.sum("k").alias("postings"))
    zero = F.lit(0).cast("long")
    kinds = every.select("lang").distinct().join(kinds, "lang", "left").na.fill(0)
    blocks = F.greatest(F.lit(1), F.ceil(F.col("postings") / BLOCK_POSTINGS)).cast("int")
    kinds = materialize(kinds.select("lang", "v", "lang_n", blocks.alias("blocks"), F.monotonically_increasing_id().alias("lang_id")),
                        "divergence-langs")
    groups = (every.join(own, ["lang", "source"], "left").join(kinds, "lang").na.fill(0, ["n"])
              .withColumn("base", share(zero, F.col("n"), F.col("v")))
              .withColumn("number", F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long") - 1))
    groups = materialize(groups, "divergence-groups")
    postings = postings.join(groups, ["lang", "source"])
    postings = postings.withColumn("p", share(F.col("c"), F.col("n"), F.col("v")))

    pairs = _pairs(postings, groups)
    above = postings.withColumn("value", F.col("p") - share(F.col("lang_c"), F.col("lang_n"), F.col("v"))).where("value > 0")
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "term")
    terms = above.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top_terms)
    terms = terms.select("lang", "source", F.lit("term").alias("part"), F.col("term").cast("string").alias("item"), "value", "rank")
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(ranked).alias("rank"))
    return pairs.unionByName(terms)


def _pairs(postings: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) of every two sources of a language, both ways."""
    names = ["lang_id", "block", "posting", "term", "source", "p", "v"]
    zero = F.lit(0).cast("long")
    block = F.pmod(F.xxhash64("term_id"), F.col("blocks")).cast("long")
    dealt = postings.select("lang_id", block.alias("block"), F.lit(1).alias("posting"), F.col("term_id").alias("term"), F.col("number").alias("source"), "p", "v")
    peers = groups.select("lang_id", F.explode(F.sequence(zero, F.col("blocks").cast("long") - 1)).alias("block"),
                          F.lit(0).alias("posting"), zero.alias("term"), F.col("number").alias("source"),
                          F.col("base").alias("p"), "v")

    def rows(batches):
        for (lang, block), unit in runs(batches, names[:2]):
            posting, term, source, p, v = (unit.column(c).to_numpy() for c in names[2:])
            peer = np.flatnonzero(posting == 0)
            base, own = p[peer[np.argsort(source[peer])]], posting == 1
            held = []
            for g, acc in accumulate(term[own], source[own], p[own], base, int(v[0]) if block == 0 else 0, block == 0):
                held.append((g, acc.tobytes()))
                if len(held) * acc.nbytes >= CHUNK:
                    yield batch_of(lang, held)
                    held = []
            if held:
                yield batch_of(lang, held)

    def batch_of(lang, held):
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(held), pa.int64()), pa.array([g for g, _ in held], pa.int64()),
                                           pa.array([a for _, a in held], pa.binary())], ["lang_id", "source", "acc"])

    def add(batches):
        for (lang, source), unit in runs(batches, ["lang_id", "source"]):
            total = sum(np.frombuffer(a.as_py(), np.int64) for a in unit.column("acc"))
            yield pa.RecordBatch.from_arrays([pa.array([lang], pa.int64()), pa.array([source], pa.int64()),
                                              pa.array([total], pa.list_(pa.int64()))], ["lang_id", "source", "acc"])

    arrays = (dealt.unionByName(peers).repartition("lang_id", "block").sortWithinPartitions("lang_id", "block")
              .mapInArrow(rows, "lang_id long, source long, acc binary"))
    sums = (arrays.repartition("lang_id", "source").sortWithinPartitions("lang_id", "source")
            .mapInArrow(add, "lang_id long, source long, acc array<bigint>"))
    slots = (sums.join(groups.select("lang_id", F.col("number").alias("source"), "lang", F.col("source").alias("name")),
                       ["lang_id", "source"])
             .select("lang", "source", "name", F.posexplode("acc").alias("peer", "x")).where("source <> peer"))
    low, high = F.least("source", F.col("peer").cast("long")), F.greatest("source", F.col("peer").cast("long"))
    pairs = slots.groupBy("lang", low.alias("low"), high.alias("high")).agg(
        F.sum("x").alias("value"), F.max(F.when(F.col("source") < F.col("peer"), F.col("name"))).alias("a"),
        F.max(F.when(F.col("source") > F.col("peer"), F.col("name"))).alias("b"))
    both = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")),
                             F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("z")
    return pairs.select("lang", both, "value").select("lang", "z.source", "z.item", "value")
