"""Secret scans by a trigram inverted index, DataFrame functions only.

1. Each rule's pattern gives a Boolean trigram query: an OR of clauses, each the
   AND of the trigrams that every match through that branch must hold.  It is
   derived from the parsed pattern: alternatives and small character classes give
   branches, literals side by side give runs, anything else ends a run.  Rules that
   ignore case, in part or in whole, are looked up in lower case.
2. Posting lists: one row per (trigram, document) for the trigrams that any query
   names.
3. Intersection: per clause the posting lists are intersected by counting how
   many of the clause's trigrams a document is listed under; clauses are united
   into each document's set of candidate rules.  The candidates are written.
4. Verification: a document's candidate rules run their regular expression over
   its whole text.  Rules without mandatory trigrams scan every text.

Results never depend on the index: it only leaves out texts that cannot match.

Cases: a null text counts as empty (no spans); texts may be of any length;
repeated ids and null ids keep one output row per input row (candidates are
found per id and verified per row); an empty table gives no rows; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import re
from re import _constants as ops
from re import _parser
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.operators.store import materialize


class Rule(NamedTuple):
    kind: str
    pattern: str            #: one regular expression, leftmost non-overlapping
    group: int = 0          #: the group whose length counts
    least: int = 0          #: its least length; shorter matches are dropped


#: The contract's three kinds, in its order.
BASE_RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]+", 0, 16),
)
#: Further kinds that this operator adds.
MORE_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]*-----END [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abpr]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("bearer", r"(?i:authorization:\x20*bearer)\x20+[A-Za-z0-9._~+/-]{16,}"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Branches that a pattern may give, and members that a character class may have to be spelled out.
BRANCHES, MEMBERS = 64, 8


def literal_branches(pattern: str) -> list[list[str]]:
    """Alternatives of a pattern, each the literal runs that every match through it holds,
    in order.  What can't be spelled out only ends a run, so the runs are mandatory."""
    def spelled(items) -> list[tuple[str, ...]]:
        """Runs of a sequence; a run goes on with what follows unless a None comes between."""
        out: list[tuple] = [()]
        for op, arg in items:
            own = item(op, arg)
            if len(out) * len(own) > BRANCHES:
                own = [(None,)]
            out = [a + b for a in out for b in own]
        return out

    def item(op, arg) -> list[tuple]:
        if op is ops.LITERAL:
            return [(chr(arg),)]
        if op is ops.AT:
            return [()]
        if op is ops.SUBPATTERN:
            return spelled(arg[-1])
        if op is ops.BRANCH:
            return [b for part in arg[1] for b in spelled(part)]
        if op is ops.IN:
            members = []
            for kind, x in arg:
                members += [chr(x)] if kind is ops.LITERAL else [chr(c) for c in range(x[0], x[1] + 1)] if kind is ops.RANGE else [None] * (MEMBERS + 1)
                if len(members) > MEMBERS:
                    return [(None,)]
            return [(c,) for c in members] if members else [(None,)]
        if op in (ops.MAX_REPEAT, ops.MIN_REPEAT):
            least, most, inner = arg
            once = spelled(inner)
            if (least, most) == (0, 1):
                return [(), *once]
            if least == most and least <= 4 and len(once) == 1:
                return [once[0] * least]
            return [(None, *b, None) for b in once] if least and len(once) <= BRANCHES else [(None,)]
        return [(None,)]

    found = []
    for branch in spelled(_parser.parse(pattern)):
        runs = "".join("\0" if c is None else c for c in branch).split("\0")
        found.append([r for r in runs if r])
    return found


def ignores_case(pattern: str) -> bool:
    """Whether any part of the pattern does."""
    def walk(items) -> bool:
        for op, arg in items:
            if op is ops.SUBPATTERN and (arg[1] & re.IGNORECASE or walk(arg[-1])):
                return True
            if op is ops.BRANCH and any(walk(x) for x in arg[1]):
                return True
            if op in (ops.MAX_REPEAT, ops.MIN_REPEAT) and walk(arg[2]):
                return True
        return False

    parsed = _parser.parse(pattern)
    return bool(parsed.state.flags & re.IGNORECASE) or walk(parsed)


def trigram_query(rule: Rule) -> list[frozenset[str]]:
    """Boolean query of a rule: an OR over sets of trigrams that must all occur.
    Empty where some branch has no trigram: such a rule scans fully."""
    fold, clauses = ignores_case(rule.pattern), []
    for runs in literal_branches(rule.pattern):
        grams = {r[i:i + 3] for r in runs for i in range(len(r) - 2)}
        clauses.append(frozenset(g.translate(str.maketrans(UPPER, LOWER)) if fold else g for g in grams))
    if not all(clauses):
        return []
    clauses = list(dict.fromkeys(clauses))
    return [c for c in clauses if not any(d < c for d in clauses)]     # a clause that asks for more is no other way


def _posting_name(gram: str, fold: bool) -> str:
    return ("i:" if fold else "c:") + gram


def candidates(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(id, kinds): the indexed rules whose trigram query each id's posting lists satisfy."""
    clauses = [(r.kind, n, sorted(_posting_name(g, ignores_case(r.pattern)) for g in c))
               for r in rules for n, c in enumerate(trigram_query(r))]
    names = sorted({g for _, _, c in clauses for g in c})
    folded = F.translate("text", UPPER, LOWER)
    held = [F.when(F.contains(F.col("low") if g[0] == "i" else F.col("text"), F.lit(g[2:])), F.lit(g)) for g in names]
    postings = (docs.select("id", "text", folded.alias("low"))
                .select("id", F.explode(F.array_compact(F.array(*held))).alias("gram")))
    wanted = docs.sparkSession.createDataFrame(
        [(g, kind, n, len(c)) for kind, n, c in clauses for g in c], "gram string, kind string, clause int, need long")
    return (postings.join(F.broadcast(wanted), "gram")  # as many rows as the rules' trigrams
            .groupBy("id", "kind", "clause").agg(F.size(F.collect_set("gram")).alias("have"), F.first("need").alias("need"))
            .where("have = need").groupBy("id").agg(F.array_sort(F.collect_set("kind")).alias("kinds")))


def bound(value: Column, f) -> Column:
    """f of a value that is worked out once, however often f names it."""
    return F.transform(F.array(value), f)[0]


def running(values: Column, add) -> Column:
    """Running results of an array of longs under an operation with zero 0.  The array is
    cut at its size's square root, so that arrays that grow step by step stay short."""
    empty = F.array().cast("array<bigint>")
    zero = F.lit(0).cast("long")

    def part(v, b):
        return lambda c: F.aggregate(F.slice(v, (c * b + 1).cast("int"), b), F.struct(zero.alias("at"), empty.alias("out")),
                                     lambda s, x: F.struct(add(s["at"], x).alias("at"), F.concat(s["out"], F.array(add(s["at"], x))).alias("out")))

    def joined(parts):
        begins = F.aggregate(parts, F.struct(zero.alias("at"), empty.alias("out")),
                             lambda s, p: F.struct(add(s["at"], p["at"]).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")))["out"]
        return F.flatten(F.zip_with(parts, begins, lambda p, h: F.transform(p["out"], lambda x: add(h, x))))

    def cut(v):
        b = F.ceil(F.sqrt(F.size(v))).cast("int")
        parts = F.transform(F.sequence(F.lit(0), (F.ceil(F.size(v) / b) - 1).cast("int")), part(v, b))
        return F.when(F.size(v) == 0, empty).otherwise(bound(parts, joined))

    return bound(values, cut)


def spans_of(text: Column, rule: Rule) -> Column:
    """array<struct<start, end>> of a rule's kept matches in a text, in code points: the
    texts between the matches give the offsets."""
    between = F.split(text, rule.pattern, -1)
    matches = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    counted = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else None
    length = lambda x: F.length(x).cast("long")

    def placed(m):
        sizes = F.transform(m, length)
        kept = F.transform(counted, length) if rule.group else sizes
        steps = F.zip_with(F.slice(between, F.lit(1), F.size(m)), m, lambda g, x: length(g) + length(x))
        every = F.arrays_zip(running(steps, lambda a, b: a + b).alias("end"), sizes.alias("size"), kept.alias("kept"))
        return F.transform(F.filter(every, lambda x: x["kept"] >= rule.least),
                           lambda x: F.struct((x["end"] - x["size"]).alias("start"), x["end"].alias("end")))

    return bound(matches, placed)


def _marked(rank: int, kind: str):
    return lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"),
                              s["end"].alias("end"), F.lit(kind).alias("kind"))


def _scan_pattern(rule: Rule) -> Rule:
    """Runs of one character class shorter than the least length can be left out
    by the pattern itself: a maximal run is one match either way."""
    if rule.group == 0 and rule.least and rule.pattern.endswith("]+"):
        head = rule.pattern[:-1]
        fixed = len(head[:head.rindex("[")])
        return rule._replace(pattern=f"{head}{{{rule.least - fixed},}}", least=0)
    return rule


def find_secrets(documents: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES,
                 keep: tuple[str, ...] = (), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, spans) for every row, plus the columns named in ``keep``; spans is
    array<struct<start, rank, end, kind>> in order, rank the rule's place in ``rules``."""
    docs = documents.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
                            F.struct(*[F.col(c).alias(c) for c in (keep or (id_col,))]).alias("kept"))
    indexed = [r for r in rules if trigram_query(r)]
    rows = docs
    if indexed:
        found = materialize(candidates(docs, rules), "secret-candidates")
        found = found.select(F.col("id").alias("cid"), "kinds")
        rows = docs.join(found, F.col("id").eqNullSafe(F.col("cid")), "left").drop("cid")
    else:
        rows = rows.withColumn("kinds", F.lit(None).cast("array<string>"))
    parts = []
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    for rank, rule in enumerate(rules):
        scan = _scan_pattern(rule)
        near = F.array_contains("kinds", rule.kind) if rule in indexed else F.rlike("text", F.lit(scan.pattern))
        got = F.when(near, spans_of(F.col("text"), scan)).otherwise(none)
        parts.append(F.transform(got, _marked(rank, rule.kind)))
    spans = F.array_sort(F.flatten(F.array(*parts)))
    return rows.select("id", "text", "kept", spans.alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


PIECE = 2048     # code points of a text's parts that are looked into for a span


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with the union of its spans replaced by ``mark``; touching and
    overlapping spans share one mark."""
    def marked(z):
        parts, s = z["parts"], z["spans"]
        before = F.concat(F.array(F.lit(0).cast("long")), running(F.transform(s, lambda x: x["end"]), lambda a, b: F.greatest(a, b)))

        def piece(a, b):
            """Code points from a up to b."""
            first, last = F.floor(a / PIECE).cast("int"), F.floor(b / PIECE).cast("int")
            at, to = (a % PIECE).cast("int"), (b % PIECE).cast("int")
            get = lambda k: F.coalesce(F.get(parts, k), F.lit(""))
            return F.when(first == last, F.substr(get(first), at + 1, to - at)).otherwise(
                F.concat(F.substr(get(first), at + 1), F.array_join(F.slice(parts, first + 2, F.greatest(last - first - 1, F.lit(0))), ""),
                         F.substr(get(last), F.lit(1), to)))

        def clean(prev):
            pairs = F.zip_with(s, F.slice(prev, F.lit(1), F.size(s)), lambda x, p: F.struct(p.alias("from"), x["start"].alias("to")))
            out = F.transform(pairs, lambda x: F.when((x["to"] < x["from"]) | ((x["to"] == x["from"]) & (x["from"] > 0)), F.lit(""))
                              .otherwise(F.concat(piece(x["from"], x["to"]), F.lit(mark))))
            end = F.length(text).cast("long")
            return F.concat(F.array_join(out, ""), piece(F.element_at(prev, -1), F.greatest(end, F.element_at(prev, -1))))

        return bound(before, clean)

    parts = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    return F.when(F.size(spans) == 0, text).otherwise(bound(F.struct(parts.alias("parts"), spans.alias("spans")), marked))
