"""Accuracy, log loss, Brier scores, calibration and invariance of predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from decisium.functions.arrays import argmax, gold_probability, masked_kl, one_hot, squared_distance

FLOOR = 1e-9


def correct(probs="probs", gold="correct_index") -> Column:
    return (argmax(probs) == (F.col(gold) if isinstance(gold, str) else gold)).cast("double")


def scores(df: DataFrame, *by: str, probs: str = "probs", gold: str = "correct_index", teacher: str | None = None) -> DataFrame:
    """n, accuracy, log_loss and Brier scores, over rows with a gold option (the teacher's Brier over all)."""
    has = F.col(gold).isNotNull()
    n = F.size(probs)
    aggs = [
        F.count_if(has).alias("n"),
        F.avg(F.when(has, correct(probs, gold))).alias("accuracy"),
        F.avg(F.when(has, -F.ln(F.greatest(gold_probability(probs, gold), F.lit(FLOOR))))).alias("log_loss"),
        F.avg(F.when(has, squared_distance(probs, one_hot(n, gold)))).alias("brier"),
    ]
    if teacher:
        aggs += [F.avg(squared_distance(probs, teacher)).alias("brier_teacher"), F.avg(masked_kl(teacher, probs)).alias("kl")]
    return (df.groupBy(*by) if by else df.groupBy()).agg(*aggs)


def calibration(df: DataFrame, bins: int = 10, probs: str = "probs", gold: str = "correct_index") -> DataFrame:
    """(bin, n, confidence, accuracy) over equal bins of [0, 1]; 1.0 belongs to the last."""
    rows = df.filter(F.col(gold).isNotNull()).select(F.array_max(probs).alias("c"), correct(probs, gold).alias("ok"))
    b = F.least(F.floor(F.col("c") * bins), F.lit(bins - 1)).cast("int")
    return rows.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg("c").alias("confidence"), F.avg("ok").alias("accuracy"))


def ece(df: DataFrame, bins: int = 10, probs: str = "probs", gold: str = "correct_index") -> DataFrame:
    found = calibration(df, bins, probs, gold)
    return found.agg((F.sum(F.col("n") * F.abs(F.col("accuracy") - F.col("confidence"))) / F.sum("n")).alias("ece"))


def ece_between(df: DataFrame, bins: int = 10, probs: str = "probs", gold: str = "correct_index") -> DataFrame:
    """Bins between the least and the largest confidence, right-open: the largest falls out, and equal ones give 0."""
    rows = df.filter(F.col(gold).isNotNull()).select(F.array_max(probs).alias("c"), correct(probs, gold).alias("ok"))
    ends = rows.agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("all"))
    both = rows.join(F.broadcast(ends), F.lit(True))  # one row
    b = F.floor((F.col("c") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)) * bins)
    per = both.withColumn("bin", b).filter(F.col("bin") < bins).groupBy("bin", "all").agg(F.count("*").alias("n"), F.avg("c").alias("confidence"), F.avg("ok").alias("accuracy"))
    return per.agg(F.coalesce(F.sum(F.col("n") / F.col("all") * F.abs(F.col("accuracy") - F.col("confidence"))), F.lit(0.0)).alias("ece"))


def invariance_error(df: DataFrame, a: str, b: str) -> DataFrame:
    """The largest difference between two predictions of a row, option by option."""
    gap = F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y)))
    return df.agg(F.coalesce(F.max(gap), F.lit(0.0)).alias("max_error"))


def ranked_options(df: DataFrame, key: str, options: str = "options", probs: str = "probs") -> DataFrame:
    """One row per option: letter of its place, probability, rank by falling probability (ties by place)."""
    rows = df.select(key, F.posexplode(F.arrays_zip(F.col(options).alias("option"), F.col(probs).alias("p"))).alias("place", "o"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.col("o.p").desc(), "place"))
    return rows.select(key, "place", F.char(F.lit(65) + F.col("place")).alias("letter"), F.col("o.option").alias("option"), F.col("o.p").alias("p"), rank.alias("rank"), (rank == 1).alias("is_top"))


def top_spans(df: DataFrame, key: str, scores_col: str, width: int = 64, k: int = 8) -> DataFrame:
    """The ``k`` tumbling windows of ``width`` tokens with the highest mean score, per row."""
    spans = df.select(key, F.posexplode(scores_col).alias("pos", "score")).groupBy(key, F.floor(F.col("pos") / width).cast("int").alias("span")).agg(F.avg("score").alias("mean_score"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.col("mean_score").desc(), "span"))
    return spans.withColumn("rank", rank).filter(F.col("rank") <= k)


def early_stop(df: DataFrame, order: str = "epoch", loss: str = "loss", patience: int = 3) -> DataFrame:
    """Each epoch's best loss so far, epochs without a new best, and whether training has stopped."""
    w = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    best = F.min(loss).over(w)
    better = (best.isNull() | (F.col(loss) < best)).cast("int")
    df = df.withColumn("better", better)
    group = F.sum("better").over(Window.orderBy(order))
    df = df.withColumn("island", group)
    stale = F.row_number().over(Window.partitionBy("island").orderBy(order)) - 1
    return df.withColumn("stale", stale).withColumn("stopped", F.max(F.col("stale")).over(Window.orderBy(order)) >= patience).drop("island", "better")
