"""Quality rules: hashed n-gram log-likelihood ratio, DataFrame functions only.

Every word and every pair of neighbouring words is hashed into one of ``BUCKETS``
buckets.  The raw multinomial counts the buckets of all documents; the
trusted-target multinomial those of documents labelled good.  A document's score is
the mean over its n-grams of log(p_target / p_raw).  The threshold is the one of
best weighted accuracy on other labelled documents, good and bad, so that it
holds for documents which the target has not seen.  A document stays if it does
not fail the base rules and its score is at least the threshold.  Every document
is scored and judged, over its whole text.

The classifier is fitted on a bounded sample of labelled rows: the
``sample_rows`` good and as many bad ids of smallest hash.  That is what makes
the sample's broadcast bounded; the raw counts cover all documents.  The table of
log ratios has ``BUCKETS`` entries at any size of the corpus.

Base columns (words are maximal runs without space and U+0009..U+000D):
word_chars, n_symbols, n_dup_lines, n_repeat_words; see the functions.

Cases: a null text has no words, fails the base rules and is not kept; without
good or without bad labels every document that passes the base rules is kept;
repeated ids are judged row by row; a repeated id in the labels counts as bad if
any of its rows does; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 14
SAMPLE_ROWS = 10_000
GOOD_WEIGHT = 10   #: losing a share of the good documents is as bad as keeping ten times that of the bad
#: Fixed values of the base rules.
SPACE = r"[\x20\x09-\x0D]+"
NON_SPACE = r"[^\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE, -1), "")


def _after(column: str, step: int) -> Column:
    """The array from its element ``step`` on."""
    return F.slice(column, step + 1, F.greatest(F.size(column) - step, F.lit(0)))


def with_hashes(df: DataFrame) -> DataFrame:
    """Adds h1, the words' hashes, and h2, those of neighbouring words; h2's last
    element has no second word."""
    df = df.withColumn("h1", F.transform("words", lambda w: F.xxhash64(w)))
    return df.withColumn("h2", F.zip_with("h1", _after("h1", 1), lambda a, b: F.xxhash64(a, b)))


def with_buckets(df: DataFrame, n: int) -> DataFrame:
    """Adds grams: the bucket of every word and of every pair of neighbouring words."""
    grams = F.concat("h1", F.slice("h2", 1, F.greatest(F.size("h1") - 1, F.lit(0))))
    return df.withColumn("grams", F.transform(grams, lambda h: F.pmod(h, F.lit(n)).cast("int")))


def _repeats(df: DataFrame) -> DataFrame:
    """n_repeat_words: words covered by 8-word windows found twice or more.
    Texts without a repeated window hash have none; in the rest, windows of equal
    hash are compared themselves, sorted so that equal ones are neighbours."""
    both = lambda a, b: F.xxhash64(a, b)
    df = df.withColumn("h4", F.zip_with("h2", _after("h2", 2), both))
    df = df.withColumn("windows", F.slice(F.zip_with("h4", _after("h4", 4), both), 1,
                                          F.greatest(F.size("words") - (WINDOW - 1), F.lit(0))))
    repeated = F.size(F.array_distinct("windows")) < F.size("windows")
    near = lambda column, field, x, k: F.coalesce(  # noqa: E731  equal to a neighbour?
        F.get(column, k - 1)[field] == x[field], F.lit(False)) | F.coalesce(
        F.get(column, k + 1)[field] == x[field], F.lit(False))
    df = df.withColumn("hashed", F.when(repeated, F.sort_array(F.transform(
        "windows", lambda h, i: F.struct(h.alias("h"), (i + 1).alias("i")))))
        .otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))).drop("h4", "windows")
    df = df.withColumn("hashed", F.filter("hashed", lambda x, k: near("hashed", "h", x, k)))
    df = df.withColumn("sorted", F.sort_array(F.transform(
        "hashed", lambda x: F.struct(F.array_join(F.slice("words", x["i"], WINDOW), " ").alias("w"), x["i"].alias("i")))))
    twice = F.filter("sorted", lambda x, k: near("sorted", "w", x, k))
    df = df.withColumn("twice", F.sort_array(F.transform(twice, lambda x: x["i"])))
    covered = F.zip_with("twice", F.slice("twice", 2, F.greatest(F.size("twice") - 1, F.lit(0))),
                         lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW))))
    return df.withColumn("n_repeat_words", F.aggregate(covered, F.lit(0).cast("long"), lambda s, x: s + x)) \
        .drop("hashed", "sorted", "twice")


def measure(docs: DataFrame) -> DataFrame:
    """(id, kept, words, h1, h2) of a table with id, text and kept, plus the base columns."""
    lines = F.filter(F.split("text", "\n", -1), lambda x: F.rlike(x, F.lit(NON_SPACE)))
    df = docs.withColumn("words", words_of(F.col("text"))).withColumn("lines", lines)
    df = df.select("id", "kept", "words",
                   F.size("words").cast("long").alias("n_words"),
                   F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
                   F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
                   (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"))
    df = _repeats(with_hashes(df))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return df.withColumn("base_failed", failed)


def labelled_sample(labels: DataFrame, rows: int = SAMPLE_ROWS, id_col: str = "doc_id") -> DataFrame:
    """(label_id, good, fits): at most ``rows`` good and ``rows`` bad ids, by smallest
    hash; half of them fit the target counts, the others the threshold."""
    one = (labels.select(F.col(id_col).alias("label_id"), F.col("quality").cast("int").alias("good"))
           .where("label_id is not null and good in (0, 1)").groupBy("label_id").agg(F.min("good").alias("good")))
    parts = [one.where(F.col("good") == g).orderBy(F.xxhash64("label_id"), "label_id").limit(rows) for g in (0, 1)]
    return parts[0].union(parts[1]).withColumn("fits", F.pmod(F.xxhash64("label_id", F.lit(1)), F.lit(2)) == 0)


def fit_ratios(docs: DataFrame, sample: DataFrame, buckets: int = BUCKETS) -> list[float] | None:
    """log(p_target / p_raw) of each bucket; None without trusted documents."""
    words = docs.select("id", words_of(F.col("text")).alias("words"))
    counts = (with_buckets(with_hashes(words), buckets).select("id", "grams")
              .join(F.broadcast(sample), F.col("id") == F.col("label_id"), "left")
              # outer: else the optimizer infers a filter that hashes every text again
              .select(F.explode_outer("grams").alias("b"),
                      F.when(F.col("fits"), F.col("good")).otherwise(F.lit(0)).alias("good"))
              .groupBy("b").agg(F.count(F.lit(1)).alias("raw"), F.sum("good").alias("target")).collect())
    counts = [r for r in counts if r["b"] is not None]  # texts without words
    raw, target = sum(r["raw"] for r in counts), sum(r["target"] for r in counts)
    if not target:
        return None
    ratios = [math.log((raw + buckets) / (target + buckets))] * buckets
    for r in counts:
        ratios[r["b"]] += math.log((r["target"] + 1) / (r["raw"] + 1))
    return ratios


def with_score(df: DataFrame, ratios: list[float]) -> DataFrame:
    """Adds score: the mean log ratio over a text's n-grams, 0 without words."""
    table = F.split(F.lit(",".join(f"{x:.6g}" for x in ratios)), ",").cast("array<double>")
    total = F.aggregate("grams", F.lit(0.0), lambda s, b: s + F.get(table, b))
    df = with_buckets(df, len(ratios))
    return df.withColumn("score", F.when(F.size("words") > 0, total / F.size("grams")).otherwise(F.lit(0.0))).drop("grams")


def fit_threshold(docs: DataFrame, sample: DataFrame, ratios: list[float]) -> float | None:
    """The threshold of best weighted accuracy on the labelled sample, midway
    between the two scores that it parts; None without good or bad documents.
    At most two scores for each row of ``SAMPLE_ROWS`` reach the driver."""
    rows = (docs.join(F.broadcast(sample.where("not fits")), F.col("id") == F.col("label_id"))
            .select("label_id", "good", words_of(F.col("text")).alias("words")))
    rows = (with_score(with_hashes(rows), ratios).groupBy("label_id")
            .agg(F.first("good").alias("good"), F.avg(F.when(F.size("words") > 0, F.col("score"))).alias("s")).collect())
    scores = sorted((r["s"], r["good"]) for r in rows if r["s"] is not None)
    n_good = sum(g for _, g in scores)
    n_bad = len(scores) - n_good
    if not n_good or not n_bad:
        return None
    best, cut, bad_below, good_below = 0.0, scores[0][0], 0, 0
    for (s, good), (after, _) in zip(scores, scores[1:]):
        good_below += good
        bad_below += 1 - good
        right = bad_below / n_bad + GOOD_WEIGHT * (1 - good_below / n_good)
        if after > s and right > best:
            best, cut = right, (s + after) / 2
    return round(cut, 6)


def settled(df: DataFrame, verdict: str) -> DataFrame:
    """The rows with a true computed verdict.  A plain filter would be pushed below
    the projections that compute it, with every intermediate array written out
    again at each of its uses; it isn't pushed below a random column."""
    return df.withColumn("_above", F.rand(0)).where(F.col(verdict) & (F.col("_above") >= 0)).drop("_above")


def judge_quality(documents: DataFrame, labels: DataFrame, keep: tuple[str, ...] = (), buckets: int = BUCKETS,
                  sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, kept struct of the columns in ``keep``, base columns, score, stays) of every row."""
    docs = documents.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
                            F.struct(*[F.col(c).alias(c) for c in (keep or (id_col,))]).alias("kept"))
    sample = labelled_sample(labels, sample_rows, "doc_id")
    slim = docs.select("id", "text")
    ratios = fit_ratios(slim, sample, buckets)
    least = fit_threshold(slim, sample, ratios) if ratios else None
    out = measure(docs)
    if ratios is None or least is None:
        out = out.withColumn("score", F.lit(0.0)).withColumn("stays", ~F.col("base_failed"))
    else:
        out = with_score(out, ratios).withColumn("stays", ~F.col("base_failed") & (F.col("score") >= least))
    return out.drop("words", "h1", "h2")
