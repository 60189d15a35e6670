"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Sources in code-point order (null last) weigh 5, 2, 1, 5, 2, 1, ... and share
``share`` times all tokens; a target stops at ``most`` times its source's size
and the excess is shared again by weight. Each source's documents are dealt by a
seeded hash into shards of about ``shard_tokens`` tokens, and a shard's documents,
in seeded order, are one stream cut into blocks of ``block_tokens`` tokens.

Seats are counted in the tokens that blocks really hold, as the last block of a
shard is short and a small source has no other. They go first to sources by the
highest quotients target / 1, / 3, / 5, ..., ``most`` times the size at most, then
each source's seats go to its shards by the highest quotients of their sizes: an
integer quota for each shard. A shard of m tokens with quota q takes every block
q div m times and q mod m tokens once more: whole blocks in the order of a seeded
permutation of the block numbers, and the beginning of the next one. A document's
``taken`` is the sum over the blocks that it lies in.

Plan: one scan counts words natively and writes (row, id, source, size, hash of the
text) to the shared folder. Sources and shards are aggregated from that, so no text
is shuffled. A hot source has many shards, its rows stay where they are when they
learn its plan, and only a shard is ever sorted by one task. The source table stays
distributed: its rank comes from a range partition with counted offsets, its targets
and quotas from a few aggregates that return sums. Shards of a source are apportioned
at most ``FAN`` at a time: beyond, first among ranges of shards, then within them.

Edge cases: null and empty texts have size 0 and take nothing; a source of size 0
has target 0. A null source is a source of its own, last. Repeated rows are
documents of their own. Equal quotients go to the first in code-point (shard)
order. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from decisium.llm.spread import spread_join
from decisium.llm.words import n_words, words
from decisium.runtime import materialise

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
BLOCK_TOKENS = 128
SHARD_TOKENS = 1 << 20
SEED = 17
#: Shards, or ranges of shards, that are apportioned at a time.
FAN = 4096

#: Large primes; any of them is prime to the number of a shard's blocks, so multiplying permutes them.
_STEPS = (1_000_000_007, 1_000_000_009, 1_000_000_021, 1_000_000_033, 1_000_000_087, 1_000_000_093, 1_000_000_097, 1_000_000_103)


def sainte_lague(weights: np.ndarray, seats: int, most: np.ndarray) -> np.ndarray:
    """Seats by the highest quotients weight / (2k + 1), k < most; ties to the first."""
    weights = np.asarray(weights, float)
    most = np.asarray(most, np.int64)
    seats = int(min(seats, most[weights > 0].sum()))
    got = np.zeros(len(weights), np.int64)
    if seats <= 0:
        return got

    def count(level: float) -> np.ndarray:
        return np.minimum(most, np.floor((weights / level + 1) / 2).astype(np.int64)) * (weights > 0)

    low, high = weights[weights > 0].min() / (2.0 * seats + 2 * most.max() + 1) / 2, weights.max() * 2
    for _ in range(200):
        mid = (low * high) ** 0.5
        if count(mid).sum() <= seats:
            high = mid
        else:
            low = mid
    got = count(high)
    while (left := seats - int(got.sum())) > 0:
        quotient = np.where((got < most) & (weights > 0), weights / (2 * got + 1), -1.0)
        first = np.argsort(-quotient, kind="stable")[: max(1, min(left, int((quotient >= quotient.max() * (1 - 1e-12)).sum())))]
        got[first] += 1
    return got


def ranked(df: DataFrame, order: list[Column]) -> DataFrame:
    """``df`` with rank (from 0) in ``order``, by ranges, without gathering rows in one task."""
    held = materialise(df.repartitionByRange(*order).withColumn("range_no", F.spark_partition_id()), "ranked")
    counts = sorted((r["range_no"], r["n"]) for r in held.groupBy("range_no").agg(F.count("*").alias("n")).collect())
    pairs, at = [], 0
    for part, n in counts:
        pairs += [F.lit(part), F.lit(at)]
        at += n
    offset = F.element_at(F.create_map(*pairs), F.col("range_no")) if pairs else F.lit(0)
    within = F.row_number().over(Window.partitionBy("range_no").orderBy(*order)) - 1
    return held.withColumn("rank", (within + offset).cast("long")).drop("range_no")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``sources`` (no_source, src, source_size) with weight and target."""
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    held = materialise(ranked(sources, [F.col("no_source"), F.col("src")]).withColumn("weight", F.get(cycle, F.pmod("rank", F.lit(len(weights))).cast("int"))), "sources")
    ceiling = F.col("source_size") * float(most)
    first = held.agg(F.sum("source_size").alias("s"), F.sum("weight").alias("w")).first()
    total = float(first["s"] or 0) * share
    level = total / first["w"] if first["w"] else 0.0
    while True:
        r = held.agg(
            F.sum(F.when(F.col("weight") * level > ceiling, ceiling)).alias("full"),
            F.sum(F.when(F.col("weight") * level <= ceiling, F.col("weight"))).alias("open"),
        ).first()
        raised = (total - (r["full"] or 0.0)) / r["open"] if r["open"] else level
        if not raised > level * (1 + 1e-15):
            break
        level = raised
    return held.withColumn("target", F.least(ceiling, F.col("weight") * level))


def source_seats(sources: DataFrame, most: int = MOST) -> DataFrame:
    """``sources`` with seats: all tokens of the mix by the highest quotients of the targets.

    The level that the last quotient reaches is searched by aggregates of 63
    levels at once; what ties or rounding leave is given out by a top-k.
    """
    held = materialise(sources, "targets")
    r = held.agg(F.sum("target").alias("t"), F.max("target").alias("m")).first()
    total = r["t"] or 0.0
    seats = int(round(total))
    if not seats:
        return held.withColumn("seats", F.lit(0).cast("long"))

    ceiling = F.floor(F.col("source_size") * most).cast("long")

    def count(level: float) -> Column:
        return F.least(ceiling, F.floor((F.col("target") / level + 1) / 2).cast("long"))

    low, high = total / seats / 8, 2.0 * r["m"]
    for _ in range(9):
        levels = [low * (high / low) ** (i / 64) for i in range(1, 64)]
        sums = held.agg(*[F.sum(count(x)).alias(f"n{i}") for i, x in enumerate(levels)]).first()
        fits = [i for i in range(63) if (sums[i] or 0) <= seats]
        i = fits[0] if fits else 63
        low, high = (low if i == 0 else levels[i - 1]), (levels[i] if i < 63 else high)
        if high / low < 1 + 1e-14:
            break
    held = held.withColumn("seats", count(high))
    left = seats - (held.agg(F.sum("seats")).first()[0] or 0)
    if left > 0:
        extra = held.filter((F.col("target") > 0) & (F.col("seats") < ceiling)).orderBy((F.col("target") / (2 * F.col("seats") + 1)).desc(), "rank").limit(left).select(F.col("rank").alias("extra_rank"))
        held = held.join(extra, F.col("rank") == F.col("extra_rank"), "left").withColumn("seats", F.col("seats") + F.col("extra_rank").isNotNull().cast("long")).drop("extra_rank")
    return held


def shard_quotas(dealt: DataFrame, planned: DataFrame, shards: int, most: int, fan: int = FAN) -> DataFrame:
    """(no_source, src, shard, shard_size, quota) of every shard that has tokens; ``shards``: the most that a source has."""
    key = ["no_source", "src"]

    def apportion(pdf):
        pdf = pdf.sort_values("unit", ignore_index=True)
        size = pdf["size"].to_numpy()
        return pdf.drop(columns="seats").assign(quota=sainte_lague(size, int(pdf["seats"].iloc[0]), size * most))

    sizes = materialise(dealt.groupBy(*key, "shard").agg(F.sum("size").alias("size")).filter("size > 0"), "shards")
    given = planned.select(*key, F.lit(0).cast("long").alias("above"), "seats")
    levels = 1
    while fan**levels < shards:
        levels += 1
    for level in reversed(range(levels)):
        unit = F.floor(F.col("shard") / F.lit(fan**level)).cast("long")
        units = sizes.groupBy(*key, unit.alias("unit")).agg(F.sum("size").alias("size")).withColumn("above", F.floor(F.col("unit") / fan).cast("long"))
        units = units.join(given, [*key, "above"]).select(*key, "above", "unit", "size", "seats")
        units = units.groupBy(*key, "above").applyInPandas(apportion, "no_source boolean, src string, above long, unit long, size long, quota long")
        units = materialise(units, "quotas")
        given = units.select(*key, F.col("unit").alias("above"), F.col("quota").alias("seats"))
    return units.select(*key, F.col("unit").alias("shard"), F.col("size").alias("shard_size"), "quota")


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
    most: int = MOST,
    block_tokens: int = BLOCK_TOKENS,
    shard_tokens: int = SHARD_TOKENS,
    seed: int = SEED,
) -> DataFrame:
    """Per row of ``docs`` (doc_id, source, text, and row_no if it has one): its size, source_size, target, taken and how its shard is taken.

    Shards and their order hang on the seed, doc_id and text alone, so reruns
    agree however the table is split into files and tasks.
    """
    own = ["row_no"] if "row_no" in docs.columns else []
    sized = docs.select(
        *own,
        "doc_id",
        F.col("source").isNull().alias("no_source"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("src"),
        n_words(F.col("text")).alias("size"),
        F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text")).alias("own"),
    )
    sized = materialise(sized, "sizes")
    key = ["no_source", "src"]
    by_source = sized.groupBy(*key).agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    planned = materialise(source_seats(targets(by_source, weights, share, most), most), "plan")
    planned = planned.select(*key, "source_size", "target", "seats", "rows", F.greatest(F.lit(1), F.ceil(F.greatest("source_size", "rows") / float(shard_tokens))).cast("long").alias("shards"))
    totals = planned.agg(F.sum("rows").alias("rows"), F.max("shards").alias("shards")).first()
    dealt = spread_join(sized, planned, key, "rows", totals["rows"] or 0).withColumn("shard", F.pmod("own", F.col("shards")))
    quotas = shard_quotas(dealt, planned, totals["shards"] or 1, most).withColumn("blocks", F.ceil(F.col("shard_size") / float(block_tokens)))
    quotas = quotas.withColumns(
        {
            "every": F.expr("quota div shard_size"),
            "more": F.pmod("quota", "shard_size").cast("long"),
            "step": F.get(F.array(*[F.lit(s) for s in _STEPS]), F.pmod(F.xxhash64(F.lit(seed), F.lit("step"), *key, F.col("shard")), F.lit(len(_STEPS))).cast("int")).cast("long"),
            "turn": F.pmod(F.xxhash64(F.lit(seed), F.lit("turn"), *key, F.col("shard")), F.col("blocks")),
        }
    )
    # the permuted blocks as one stream of whole blocks: what lies before ``stop`` comes once more
    short = F.pmod("shard_size", F.lit(block_tokens))
    before = block_turn(F.col("blocks") - 1) * block_tokens + short
    quotas = quotas.withColumn("stop", F.col("more") + F.when((short > 0) & (F.col("more") >= before), block_tokens - short).otherwise(0)).drop("shard_size")
    order = Window.partitionBy(*key, "shard").orderBy(F.xxhash64(F.lit("order"), "own"), "doc_id", "size", *own)
    placed = dealt.withColumn("start", F.sum("size").over(order) - F.col("size"))
    placed = placed.join(quotas, [*key, "shard"], "left")
    b = float(block_tokens)
    first, last = F.floor(F.col("start") / b), F.floor((F.col("start") + F.col("size") - 1) / b)

    def part(a: Column, k: Column) -> Column:
        begin = F.greatest(F.col("start") - k * block_tokens, F.lit(0))
        end = F.least(F.col("start") + F.col("size") - k * block_tokens, F.lit(block_tokens))
        return a + (end - begin) * F.col("every") + F.greatest(F.least(end, F.col("stop") - block_turn(k) * block_tokens) - begin, F.lit(0))

    taken = F.when(
        (F.col("size") > 0) & F.col("blocks").isNotNull(),
        F.aggregate(F.sequence(first, F.greatest(first, last)), F.lit(0).cast("long"), lambda a, k: (part(a, k)).cast("long")),
    ).otherwise(F.lit(0).cast("long"))
    return placed.select(*own, "doc_id", "size", "source_size", "target", taken.alias("taken"), "start", "blocks", "every", "stop", "step", "turn")


def block_turn(k: Column) -> Column:
    """The place of block ``k`` among its shard's permuted blocks."""
    return F.pmod(F.pmod(k, F.col("blocks")) * F.col("step") + F.col("turn"), F.col("blocks"))


def token_times(at: Column, block_tokens: int) -> Column:
    """How often the token at ``at`` of a row's shard is taken."""
    place = block_turn(F.floor(at / float(block_tokens))) * block_tokens + F.pmod(at, F.lit(block_tokens))
    return F.col("every") + F.when(place < F.col("stop"), F.lit(1)).otherwise(F.lit(0))


def mixed_documents(docs: DataFrame, seed: int = SEED, most: int = MOST, block_tokens: int = BLOCK_TOKENS, **rest) -> DataFrame:
    """The documents of the mix, with the columns of ``docs``.

    Each document comes as often as any of its words is taken (``most`` at most);
    the k-th time it holds the words that are taken k times or more: its whole
    text where that is all of them, else those words joined by single spaces.
    """
    columns = docs.columns
    rows = docs.select(F.struct(*[docs[c] for c in columns]).alias("own_row"), "doc_id", "source", "text")
    held = materialise(rows.withColumn("row_no", F.monotonically_increasing_id()), "mixed")
    plan = mix(held, seed=seed, most=most, block_tokens=block_tokens, **rest).filter(F.col("taken") > 0)
    plan = plan.select(F.col("row_no").alias("plan_row"), "start", "blocks", "every", "stop", "step", "turn")
    df = held.join(plan, F.col("row_no") == F.col("plan_row"))
    df = df.withColumn("own_words", words(F.col("text"))).withColumn(
        "times", F.transform("own_words", lambda w, i: token_times(F.col("start") + i, block_tokens))
    )
    df = df.withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.array_max("times").cast("int"))))
    whole = F.array_min("times") >= F.col("copy_no")
    some = F.array_join(F.filter("own_words", lambda w, i: F.get("times", i) >= F.col("copy_no")), " ")
    df = df.withColumn("text", F.when(whole, F.col("text")).otherwise(some))
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return df.select(*[new.get(c, F.col("own_row")[c]).alias(c) for c in columns])
