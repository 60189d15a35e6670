"""Preference formatting: a shared prompt and two masked completions per pair.

A pair is a chosen and a rejected conversation. Their longest common prefix of
turns (equal role and text) is rendered once as the prompt; what follows in each
is its completion. Completions come with the spans (code points, end exclusive)
that training may learn from: the texts of assistant turns with their end marks;
role headers and all other turns are masked. Native columns only.

Edge cases: a null role or text counts and renders as empty, and equals empty.
Turns are ordered by turn, then role and text, so ties and repeated rows have
one order. Without a common turn the prompt is empty; if one conversation is a
prefix of the other its completion is empty. Marks inside a text are broken up by
a backslash, so a text can't end its turn. A conversation that only one side has
gives a pair with an empty other side. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
LEARNED = "assistant"


def turn_list(turns: DataFrame, key: str) -> DataFrame:
    """(key, turns array<struct<turn, role, text>>) in order, null role and text as empty."""
    item = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return turns.groupBy(key).agg(F.sort_array(F.collect_list(item)).alias("turns"))


def common_turns(a: Column, b: Column) -> Column:
    """How many turns both begin with."""
    n = F.least(F.size(a), F.size(b))
    alike = F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: (x["role"] == y["role"]) & (x["text"] == y["text"]))
    first = F.array_position(alike, False)
    return F.when(first == 0, n.cast("long")).otherwise(first - 1).cast("int")


def _head(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), F.replace(turn["role"], F.lit("<|"), F.lit("<\\|")), F.lit("\n"))


def _body(turn: Column) -> Column:
    return F.concat(F.replace(turn["text"], F.lit("<|"), F.lit("<\\|")), F.lit(CLOSE))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), _body(t))), "")


def learned_spans(turns: Column) -> Column:
    """array<struct<start, stop>> of the parts of ``render(turns)`` to learn from."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        begin = acc["at"] + F.length(_head(t))
        stop = begin + F.length(_body(t))
        own = F.array(F.struct(begin.cast("int").alias("start"), stop.cast("int").alias("stop")))
        return F.struct(stop.cast("int").alias("at"), F.when(t["role"] == LEARNED, F.concat(acc["spans"], own)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(turns, start, step, lambda acc: acc["spans"])


def preference_pairs(chosen: DataFrame, rejected: DataFrame, key: str = "pair_id") -> DataFrame:
    """(key, n_prompt_turns, prompt, chosen, chosen_spans, rejected, rejected_spans) from turn tables (key, turn, role, text)."""
    a = turn_list(chosen, key).withColumnRenamed("turns", "a")
    b = turn_list(rejected, key).select(F.col(key).alias("other_key"), F.col("turns").alias("b"))
    none = F.array().cast(a.schema["a"].dataType)
    both = a.join(b, F.col(key).eqNullSafe(F.col("other_key")), "full_outer").select(F.coalesce(key, "other_key").alias(key), F.coalesce("a", none).alias("a"), F.coalesce("b", none).alias("b"))
    return format_pairs(both, key)


def format_pairs(both: DataFrame, key: str) -> DataFrame:
    """As ``preference_pairs`` from (key, a, b), the turn arrays of both sides."""
    df = both.withColumn("n", common_turns(F.col("a"), F.col("b")))
    df = df.select(
        key,
        F.col("n").alias("n_prompt_turns"),
        F.slice("a", 1, F.col("n")).alias("p"),
        F.slice("a", F.col("n") + 1, F.greatest(F.size("a") - F.col("n"), F.lit(0))).alias("a"),
        F.slice("b", F.col("n") + 1, F.greatest(F.size("b") - F.col("n"), F.lit(0))).alias("b"),
    )
    return df.select(
        key,
        "n_prompt_turns",
        render(F.col("p")).alias("prompt"),
        render(F.col("a")).alias("chosen"),
        learned_spans(F.col("a")).alias("chosen_spans"),
        render(F.col("b")).alias("rejected"),
        learned_spans(F.col("b")).alias("rejected_spans"),
    )


def shortened(turns: Column) -> Column:
    """``turns`` with the last assistant turn's text cut to its first half (rounded down)."""
    learned = F.transform(turns, lambda t: t["role"] == LEARNED)
    last = F.size(turns) - F.array_position(F.reverse(learned), True)  # from 0; past the end if there is none
    return F.transform(
        turns,
        lambda t, i: F.when(
            (i == last) & (t["role"] == LEARNED),
            F.struct(t["turn"].alias("turn"), t["role"].alias("role"), F.substring(t["text"], F.lit(1), F.floor(F.length(t["text"]) / 2).cast("int")).alias("text")),
        ).otherwise(t),
    )


def shortened_pairs(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """Pairs of each conversation (chosen) and itself with a shortened last answer (rejected)."""
    own = turn_list(turns, key).withColumnRenamed("turns", "a")
    return format_pairs(own.withColumn("b", shortened(F.col("a"))), key)
