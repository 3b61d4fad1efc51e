"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a text and an action.  ``host/path`` rules fit the host and all its
subdomains when the url's path starts with the rule's path.  A rule that starts
with ``*`` is a pattern over host, path and query in which every further ``*``
stands for any characters.

Every rule becomes a regular expression plus the literal tokens that any url it
fits must hold as whole tokens.  The rule is filed under the one of these that
the fewest urls of the table hold.  A url's own tokens fetch its candidate
rules, and only those run their regular expression; rules without a whole
literal token are candidates of every url.  Among the rules that fit, the
longest text wins, ties by text.

Cases: a null url, or one without ``://``, has empty host and path and fits no
rule; an empty table gives no rows; repeated rows are judged alike; columns
other than the id and the url are ignored, whatever their names.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The contract's host rules.
HOST_RULES = (("net/", "block"), ("example.net/en/", "allow"),
              ("example.com/de/", "block"), ("org/fr/", "allow"))
#: Pattern rules that decide where no host rule fits.
PATTERN_RULES = (("*/ads/*", "block"), ("*/adserver/*", "block"), ("*/banner/*", "block"),
                 ("*.doubleclick.*", "block"), ("*/login/*", "block"), ("*/cart/*", "block"),
                 ("*/wp-admin/*", "block"), ("*/tracking/pixel.gif*", "block"), ("*/docs/*", "allow"))
DEFAULT_VERDICT = "allow"
TOKEN = "[A-Za-z0-9]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Rule(NamedTuple):
    text: str
    action: str
    regex: str
    literals: tuple[str, ...]


def compile_rule(text: str, action: str) -> Rule:
    """Regular expression over host + path + query, and the whole tokens it needs."""
    if text.startswith("*"):
        chunks = text.split("*")
        regex = ".*".join(re.escape(c) for c in chunks[1:])
        found = [c[m.start():m.end()] for c in chunks for m in re.finditer(TOKEN, c)
                 if m.start() > 0 and m.end() < len(c)]
    else:
        host, slash, path = text.partition("/")
        host, path = host.lower(), slash + path
        regex = rf"\A(?:[^/?#]*\.)?{re.escape(host)}(?=[/?#]|\Z){re.escape(path)}"
        found = re.findall(TOKEN, host)
        found += [m.group() for m in re.finditer(TOKEN, path) if m.end() < len(path)]
    return Rule(text, action, regex, tuple(dict.fromkeys(found)))


def url_parts(url):
    """(host, path, rest) columns; empty texts for a null url or one without ``://``."""
    at = F.instr(url, "://")
    tail = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    tail = F.coalesce(tail, F.lit(""))
    host = F.regexp_extract(tail, r"\A[^/?#]*", 0)
    path = F.regexp_extract(tail, r"\A[^/?#]*([^?#]*)", 1)
    rest = F.regexp_extract(tail, r"(?s)\A[^?#]*(.*)", 1)
    return F.translate(host, UPPER, LOWER), path, rest


def token_frequencies(urls: DataFrame, rules: list[Rule]) -> dict[str, int]:
    """Number of urls that hold each literal token of the rules (one row per
    token of the rules, so the answer is as small as the rules)."""
    wanted = sorted({t for r in rules for t in r.literals})
    if not wanted:
        return {}
    held = F.array_distinct(F.regexp_extract_all("full", F.lit(f"({TOKEN})"), F.lit(1)))
    rows = (urls.select(F.explode(F.array_intersect(held, F.array(*map(F.lit, wanted)))).alias("token"))
            .groupBy("token").count().collect())
    return {t: 0 for t in wanted} | {r["token"]: r["count"] for r in rows}


def build_index(rules: list[Rule], frequency: dict[str, int]) -> tuple[dict[str, list[int]], list[int]]:
    """Token -> rule numbers under their rarest token, and rules without a token."""
    index: dict[str, list[int]] = {}
    always = []
    for n, r in enumerate(rules):
        if r.literals:
            index.setdefault(min(r.literals, key=lambda t: (frequency.get(t, 0), t)), []).append(n)
        else:
            always.append(n)
    return index, always


def filter_urls(pages: DataFrame, host_rules=HOST_RULES, pattern_rules=PATTERN_RULES,
                default: str = DEFAULT_VERDICT, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict, pattern, n_candidates) for every row."""
    rules = [compile_rule(*r) for r in (*host_rules, *pattern_rules)]
    n_host = len(host_rules)
    host, path, rest = url_parts(F.col(url_col))
    urls = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"), rest.alias("rest"))
    urls = urls.withColumn("full", F.concat("host", "path", "rest"))
    index, always = build_index(rules, token_frequencies(urls, rules))

    @F.pandas_udf("rule string, verdict string, pattern string, n_candidates int")
    def judge(fulls: pd.Series) -> pd.DataFrame:
        tokens = re.compile(TOKEN)
        tests = [re.compile(r.regex, re.S) for r in rules]
        out = []
        for full in fulls:
            near = {n for t in set(tokens.findall(full)) for n in index.get(t, ())}.union(always)
            fits = [n for n in near if tests[n].search(full)]
            best = min(fits, key=lambda n: (n >= n_host, -len(rules[n].text), rules[n].text), default=None)
            if best is None:
                out.append((None, default, None, len(near)))
            elif best < n_host:
                out.append((rules[best].text, rules[best].action, None, len(near)))
            else:
                out.append((None, rules[best].action, rules[best].text, len(near)))
        return pd.DataFrame(out, columns=["rule", "verdict", "pattern", "n_candidates"])

    return (urls.withColumn("v", judge("full"))
            .select(F.col("id").alias(id_col), "host", "path", "v.rule", "v.verdict", "v.pattern", "v.n_candidates"))
