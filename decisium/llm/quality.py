"""Quality rules: base counts and a hashed n-gram log-likelihood ratio. Native columns only.

Words and pairs of neighbouring words are hashed into ``buckets`` buckets. Two
multinomials over the buckets are estimated: the raw corpus from every document,
the trusted target from documents that ``labels`` call good and not toxic (at
most ``target_rows`` of them, those with the smallest id hashes: the documented
bound of the labelled sample, and what makes the broadcast of their ids safe).
Both get the same share of smoothing, so a bucket without evidence weighs 0. A
document's score is the sum of its n-grams' log ratios ``log(target / raw)``
divided by their number; it is kept if no base rule fails and the score reaches
``threshold``. The threshold is a number, so reruns agree.

Plan: one scan counts (explode, partial and final hash aggregate over a fixed
number of buckets, so the shuffle doesn't grow with the corpus), one scan scores
each row where it is; texts are never shuffled. Between them the driver holds
the ``buckets`` log ratios, whatever the corpus's size.

Edge cases: null and empty texts have no words, fail the base rule and score 0.
Without a usable label every ratio is 0, so the base rules decide alone. Repeated
rows are judged alike. Texts of a single word have no pair. An empty table gives
an empty result. Extra columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from decisium.llm.words import SPACES, spaced, words

BUCKETS = 1 << 16
THRESHOLD = -0.1
#: Counts that each bucket of the target gets before any evidence.
SMOOTHING = 4.0
TARGET_ROWS = 50_000
#: Words of a repeat window.
WINDOW = 8
VERDICT = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept")


def _shifted(array: Column, by: int, size: Column) -> Column:
    """``size`` elements (none below 0) of ``array`` from place ``by`` on."""
    return F.slice(array, 1 + by, F.greatest(size, F.lit(0)))


def pair_hashes(w: Column) -> Column:
    """array<bigint>: the hash of each word and the next; the hash of a struct is that of its fields."""
    both = F.arrays_zip(_shifted(w, 0, F.size(w) - 1).alias("a"), _shifted(w, 1, F.size(w) - 1).alias("b"))
    return F.transform(both, lambda s: F.xxhash64(s))


def base_counts(df: DataFrame) -> DataFrame:
    """``df`` (with text) without text, and with hashes, pairs, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words.

    A repeat window is ``WINDOW`` neighbouring words, hashed as its ``WINDOW`` / 2 pairs
    side by side; windows are told apart by that 64-bit hash. Only texts in which some
    hash occurs twice are sorted to find which words lie in such windows.
    """
    own = [c for c in df.columns if c != "text"]
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.btrim(x, F.lit(SPACES))) > 0)
    df = df.select(
        *own,
        words(F.col("text")).alias("w"),
        F.length(F.replace(spaced(F.col("text")), F.lit(" "), F.lit(""))).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        lines.alias("lines"),
    )
    df = df.select(
        *own,
        F.size("w").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("w", lambda x: F.xxhash64(x)).alias("hashes"),
        pair_hashes(F.col("w")).alias("pairs"),
    )
    windows = F.arrays_zip(*[_shifted(F.col("pairs"), k, F.size("pairs") - (WINDOW - 2)).alias(f"p{k}") for k in range(0, WINDOW, 2)])
    df = df.withColumn("win", F.transform(windows, lambda s: F.xxhash64(s)))
    some = F.size("win") > F.size(F.array_distinct("win"))
    df = df.withColumn("win", F.when(some, F.array_sort(F.transform("win", lambda x, i: F.struct(x.alias("h"), (i + 1).alias("i"))))))

    def again(e: Column, k: Column) -> Column:
        before = F.get("win", F.greatest(k - 1, F.lit(0)))["h"]
        after = F.get("win", F.least(k + 1, F.size("win") - 1))["h"]
        return ((k > 0) & (before == e["h"])) | ((k < F.size("win") - 1) & (after == e["h"]))

    df = df.withColumn("win", F.array_sort(F.transform(F.filter("win", again), lambda e: e["i"])))
    covered = F.aggregate(
        F.transform("win", lambda i, k: F.when(k == 0, F.lit(WINDOW)).otherwise(F.least(F.lit(WINDOW), i - F.get("win", F.greatest(k - 1, F.lit(0)))))),
        F.lit(0).cast("long"),
        lambda a, x: a + x.cast("long"),
    )
    return df.select(*[c for c in df.columns if c != "win"], F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"))


def log_ratios(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, smoothing: float = SMOOTHING, target_rows: int = TARGET_ROWS) -> Column:
    """array<double> literal: the log ratio of each bucket, counted over all of ``docs``."""
    good = labels.filter((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0) & F.col("doc_id").isNotNull())
    trusted = good.select(F.col("doc_id").alias("trusted_id")).distinct().orderBy(F.xxhash64("trusted_id"), "trusted_id").limit(target_rows)
    w = F.col("w")
    both = F.arrays_zip(w.alias("a"), _shifted(w, 1, F.size(w) - 1).alias("b"))  # the last word has no next one
    grams = (
        docs.select(F.col("doc_id").alias("own_id"), words(F.col("text")).alias("w"))
        .join(F.broadcast(trusted), F.col("own_id") == F.col("trusted_id"), "left")
        .select(F.explode(both).alias("s"), F.col("trusted_id").isNotNull().cast("long").alias("is_target"))
        .select(F.explode(F.array(F.xxhash64("s.a"), F.when(F.col("s.b").isNotNull(), F.xxhash64("s.a", "s.b")))).alias("h"), "is_target")
        .filter(F.col("h").isNotNull())
        .select(F.pmod("h", F.lit(buckets)).cast("int").alias("bucket"), "is_target")
    )
    counts = grams.groupBy("bucket").agg(F.count("*").cast("double").alias("raw"), F.sum("is_target").cast("double").alias("target"))
    # one row of a fixed number of buckets
    row = counts.agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"), F.collect_list(F.struct("bucket", "raw", "target")).alias("m"))
    share = F.col("target") / F.col("raw")
    ratio = F.transform("m", lambda e: F.struct(e["bucket"].alias("b"), F.ln((e["target"] + smoothing) / (e["raw"] * share + smoothing)).alias("v")))
    found = row.select(F.when(F.col("target") > 0, ratio).alias("r")).select(
        F.array_join(F.transform(F.array_sort("r"), lambda e: F.concat_ws(":", e["b"].cast("string"), F.format_string("%.9f", e["v"]))), ",").alias("r")
    ).first()
    values = ["0"] * buckets
    for entry in (found["r"] or "").split(",") if found["r"] else ():
        b, v = entry.split(":")
        values[int(b)] = v
    return F.split(F.lit(",".join(values)), ",").cast("array<double>")


def judge(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, threshold: float = THRESHOLD, smoothing: float = SMOOTHING, target_rows: int = TARGET_ROWS) -> DataFrame:
    """(own_row, doc_id, base counts, base_failed, score, kept) of every row; own_row holds all columns of ``docs``."""
    ratios = log_ratios(docs, labels, buckets, smoothing, target_rows)
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("own_row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    df = base_counts(rows)

    def total(hashes: str) -> Column:
        return F.aggregate(hashes, F.lit(0.0), lambda a, h: a + F.get(ratios, F.pmod(h, F.lit(buckets))))

    n_grams = F.size("hashes") + F.size("pairs")
    df = df.withColumn("score", (total("hashes") + total("pairs")) / F.greatest(n_grams, F.lit(1)))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    df = df.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))
    # one element per row: a later filter on a verdict stays above this and doesn't repeat all of its expressions
    verdict = F.struct(*VERDICT)
    return df.select("own_row", "doc_id", F.explode(F.array(verdict)).alias("verdict")).select("own_row", "doc_id", "verdict.*")
