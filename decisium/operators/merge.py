"""Corpus merge: guards, ordered dedup, splits, rebalance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from decisium.functions.hashing import sha_order
from decisium.runtime import materialise

#: Hexadecimal digits of the hash by which rows are counted before any is ranked.
BIN_DIGITS = 4


def without(df: DataFrame, guard: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't in ``guard`` (an anti join; Spark broadcasts a small guard by its measured size)."""
    return df.join(guard.select(F.col(key).alias("guard_key")).distinct(), F.col(key) == F.col("guard_key"), "left_anti")


def within(df: DataFrame, guard: DataFrame, key: str) -> DataFrame:
    return df.join(guard.select(F.col(key).alias("guard_key")).distinct(), F.col(key) == F.col("guard_key"), "left_semi")


def require_no_leak(df: DataFrame, guard: DataFrame, key: str) -> DataFrame:
    """``df``, or an error if any of its keys is reserved."""
    if within(df, guard, key).limit(1).count():
        raise ValueError("reserved rows occur in the corpus")
    return df


def first_per_key(df: DataFrame, key: str, order: str = "seq") -> DataFrame:
    """The row that came first of each key.

    Only (key, order) is aggregated, with partial sums before the shuffle, so a key
    of a third of all rows costs no task more than the others; rows stay unsorted.
    ``order`` must be unique. The pairs are written first, so keys are computed once.
    """
    first = materialise(df.select(key, order), "keys").groupBy(key).agg(F.min(order).alias("first_order"))
    return df.join(first.select("first_order"), F.col(order) == F.col("first_order"), "left_semi")


def hash_first(df: DataFrame, group: str, limits: DataFrame, flag: str, seed: int, *ids: str) -> DataFrame:
    """``df`` with ``flag``: whether a row is among the first ``most`` of its group in hash order of ``ids``, ties by the last of them.

    ``limits``: (group, most) of each group, one row each; a group without a row has none.
    Rows are counted by the beginnings of their hashes, and only those that share theirs
    with the group's last wanted row are sorted: no group ever meets in one task.
    """
    draw = sha_order(seed, *ids)
    begins = F.substring(draw, 1, BIN_DIGITS)
    counts = df.groupBy(F.col(group).alias("bin_group"), begins.alias("bin")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("bin_group").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    wanted = limits.select(F.col(group).alias("limit_group"), F.col("most").cast("long").alias("most"))
    held = counts.withColumn("before", before).join(wanted, F.col("bin_group").eqNullSafe(F.col("limit_group")))
    full = F.col("before") + F.col("n") <= F.col("most")
    # the bin after the last one that is wanted whole, and how many rows of it; "g" follows every hash
    first = F.min(F.when(~full, F.struct("bin", (F.col("most") - F.col("before")).alias("more"))))
    border = held.groupBy("bin_group").agg(first.alias("first")).select("bin_group", F.coalesce("first.bin", F.lit("g")).alias("border"), F.coalesce("first.more", F.lit(0)).alias("more"))
    border = materialise(border, "border")
    placed = df.withColumn("draw", draw).withColumn("bin", begins).join(border, F.col(group).eqNullSafe(F.col("bin_group")), "left")
    edge = F.coalesce(F.col("bin") == F.col("border"), F.lit(False))
    far = placed.filter(~edge).withColumn(flag, F.coalesce(F.col("bin") < F.col("border"), F.lit(False)))
    rank = F.row_number().over(Window.partitionBy(group).orderBy("draw", ids[-1]))
    near = placed.filter(edge).withColumn(flag, rank <= F.col("more"))
    return far.unionByName(near).select(*df.columns, flag)


def numbered(df: DataFrame, key: str, order: str, number: str) -> DataFrame:
    """``df`` with ``number``: 1, 2, ... among the rows of a key in ``order`` (unique); null keys aren't numbered apart.

    Rows are dealt by ranges of (key, order), so a key of a third of all rows lies in many tasks.
    Only the first key of a range can go on from the ranges before; the driver adds those up, a row a range.
    """
    held = materialise(df.repartitionByRange(F.col(key), F.col(order)).withColumn("range_no", F.spark_partition_id()), "ranges")
    edges = held.groupBy("range_no").agg(F.min(key).alias("low"), F.max(key).alias("high"))
    own = held.select("range_no", F.col(key).alias("own_key")).join(F.broadcast(edges), "range_no")
    sizes = own.groupBy("range_no", "low", "high").agg(F.count_if(F.col("own_key") == F.col("low")).alias("n_low"), F.count_if(F.col("own_key") == F.col("high")).alias("n_high"))
    went, carried, so_far = [], None, 0
    for r in sorted(sizes.collect(), key=lambda r: r["range_no"]):
        before = so_far if r["low"] == carried else 0
        went.append((r["range_no"], before))
        carried, so_far = r["high"], r["n_high"] + (before if r["low"] == r["high"] else 0)
    spark = df.sparkSession
    offsets = edges.join(F.broadcast(spark.createDataFrame(went, "range_no int, before long")), "range_no").drop("high")
    place = F.row_number().over(Window.partitionBy("range_no", key).orderBy(order))
    out = held.join(F.broadcast(offsets), "range_no").withColumn(number, place + F.when(F.col(key) == F.col("low"), F.col("before")).otherwise(0))
    return out.select(*df.columns, number)


def suffixed_ids(df: DataFrame, existing: DataFrame | None = None, key: str = "id", order: str = "seq") -> DataFrame:
    """``df`` with ids made unique: a later row of an id, or one that exists already, gets ``#n``."""
    taken = F.lit(0)
    df = numbered(df, key, order, "id_no")
    if existing is not None:
        df = df.join(existing.select(F.col(key).alias("old_id")).distinct(), F.col(key) == F.col("old_id"), "left")
        taken = F.col("old_id").isNotNull().cast("int")
    df = df.withColumn("id_no", F.col("id_no") + taken)
    return df.withColumn(key, F.when(F.col("id_no") > 1, F.concat(F.col(key), F.lit("#"), F.col("id_no").cast("string"))).otherwise(F.col(key))).drop("id_no", "old_id")


def eval_size(n: Column, fraction: float) -> Column:
    """At least one, half-even rounding."""
    return F.greatest(F.lit(1), F.bround(n * F.lit(fraction).cast("double"), 0).cast("long"))


def split_by_fraction(df: DataFrame, fraction: float = 0.1, seed: int = 7, family: str = "family", row_id: str = "id") -> DataFrame:
    """``df`` with is_eval: the rows first in hash order, per family."""
    limits = df.groupBy(family).agg(eval_size(F.count("*"), fraction).alias("most"))
    return hash_first(df, family, limits, "is_eval", seed, family, row_id)


def split_by_topic(df: DataFrame, fraction: float = 0.15, seed: int = 7, family: str = "family", topic: str = "topic", row_id: str = "id") -> DataFrame:
    """``df`` with is_eval: whole topics in hash order until the target is reached, then rows without topic.

    A topic is in eval iff the topics before it hold fewer rows than the target.
    Only topic counts are sorted; rows are joined to their topic's verdict.
    """
    keyed = df.filter(F.col(topic).isNotNull())
    sizes = keyed.groupBy(family, topic).agg(F.count("*").alias("n"))
    totals = df.groupBy(family).agg(F.count("*").alias("n_all")).select(F.col(family).alias("f_total"), eval_size(F.col("n_all"), fraction).alias("target"))
    sizes = sizes.join(totals, F.col(family) == F.col("f_total"))
    order = Window.partitionBy(family).orderBy(sha_order(seed, family, topic), topic).rowsBetween(Window.unboundedPreceding, -1)
    chosen = sizes.withColumn("eval_topic", F.coalesce(F.sum("n").over(order), F.lit(0)) < F.col("target"))
    got = chosen.groupBy(family).agg(F.sum(F.when(F.col("eval_topic"), F.col("n")).otherwise(0)).alias("assigned")).select(F.col(family).alias("f_got"), "assigned")
    lacking = totals.join(got, F.col("f_total") == F.col("f_got"), "left").select("f_total", F.greatest(F.lit(0), F.col("target") - F.coalesce("assigned", F.lit(0))).alias("deficit"))
    flags = chosen.select(F.col(family).alias("f_topic"), F.col(topic).alias("t_topic"), "eval_topic")
    with_topic = keyed.join(flags, (F.col(family) == F.col("f_topic")) & (F.col(topic) == F.col("t_topic"))).withColumn("is_eval", F.col("eval_topic")).drop("f_topic", "t_topic", "eval_topic")
    bare = hash_first(df.filter(F.col(topic).isNull()), family, lacking.select(F.col("f_total").alias(family), F.col("deficit").alias("most")), "is_eval", seed, family, row_id)
    return with_topic.unionByName(bare)


def split_forced(df: DataFrame, side: str, free_split) -> DataFrame:
    """Rows that name a side keep it; ``free_split`` decides the others."""
    forced = df.filter(F.col(side).isin("train", "eval")).withColumn("is_eval", F.col(side) == "eval")
    free = df.filter(~F.coalesce(F.col(side).isin("train", "eval"), F.lit(False)))
    return forced.unionByName(free_split(free))


def rebalance(df: DataFrame, fraction: float = 0.09, seed: int = 7, family: str = "family", split: str = "split", row_id: str = "id") -> DataFrame:
    """``df`` with the split moved: families short of eval rows give train rows in hash order."""
    counts = df.groupBy(family).agg(F.count("*").alias("n_all"), F.count_if(F.col(split) == "eval").alias("n_eval"), F.count_if(F.col(split) == "train").alias("n_train"))
    need = F.bround(F.col("n_all") * F.lit(fraction).cast("double"), 0).cast("long") + 1
    short = counts.filter("n_train > 0").select(family, F.greatest(F.lit(0), need - F.col("n_eval")).alias("most")).filter("most > 0")
    moved = hash_first(df.filter(F.col(split) == "train"), family, short, "moves", seed, family, row_id)
    moved = moved.withColumn(split, F.when(F.col("moves"), "eval").otherwise(F.col(split))).drop("moves")
    return moved.unionByName(df.filter(F.coalesce(F.col(split) != "train", F.lit(True))))
