"""Census and gate reports: one pass each, no rescan per family."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from decisium.functions.arrays import bigrams, gold_probability, total
from decisium.functions.text import ascii_words, shortened, word_count
from decisium.operators.validate import gold_is_padding
from decisium.runtime import materialise


def family_mix(df: DataFrame, family: str = "family", order: str = "seq") -> DataFrame:
    """Rows per family; ties in the order of first rows."""
    return df.groupBy(family).agg(F.count("*").alias("n"), F.min(order).alias("first_seq")).orderBy(F.col("n").desc(), "first_seq")


def option_histogram(df: DataFrame, *by: str, options: str = "options") -> DataFrame:
    return df.groupBy(*by, F.size(options).alias("n_options")).agg(F.count("*").alias("n"))


def family_option_counts(df: DataFrame, family: str = "family", options: str = "options") -> DataFrame:
    """Rows with fewer than eight, exactly four and exactly eight options."""
    n = F.size(options)
    return df.groupBy(family).agg(F.count_if(n < 8).alias("n_lt8"), F.count_if(n == 4).alias("n_4"), F.count_if(n == 8).alias("n_8"), F.count("*").alias("n"))


def probability_class(probs: str = "probs", options: str = "options", gold: str = "correct_index") -> Column:
    """bad sum, missing gold, gold below one half, below 0.9, padding marked as gold, else ok; the first that holds."""
    g = gold_probability(probs, gold)
    return (
        F.when(F.abs(total(probs) - 1) > 0.01, "bad_sum")
        .when(F.col(gold).isNull(), "no_gold")
        .when(gold_is_padding(options, gold), "na_gold")
        .when(g < 0.5, "gold_low")
        .when(g < 0.9, "gold_soft")
        .otherwise("ok")
    )


def context_median(df: DataFrame, family: str = "family", context: str = "context") -> DataFrame:
    return df.groupBy(family).agg(F.percentile(word_count(context), 0.5).alias("median_words"))


def top_bigrams(df: DataFrame, k: int = 10, text: str = "context", across: str | None = None) -> DataFrame:
    """The most frequent neighbouring words of a row's text; ties alphabetically.

    With ``across``, a column of unique numbers, all texts are one stream in its order: the
    last word of a text and the first of the next one that has words are neighbours too.
    """
    words = df.select(*([across] if across else []), ascii_words(text).alias("words"))
    pairs = words.select(F.explode(bigrams("words")).alias("bigram"))
    if across:
        pairs = pairs.unionByName(_borders(words, across))
    return pairs.groupBy("bigram").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "bigram").limit(k)


def _borders(words: DataFrame, order: str) -> DataFrame:
    """(bigram) of each text's last word and the next one's first, by ranges: only a range's ends reach the driver."""
    ends = words.filter(F.size("words") > 0).select(order, F.get("words", F.lit(0)).alias("first"), F.element_at("words", -1).alias("last"))
    held = materialise(ends.repartitionByRange(F.col(order)).withColumn("range_no", F.spark_partition_id()), "ends")
    following = F.lead("first").over(Window.partitionBy("range_no").orderBy(order))
    inside = held.select("last", following.alias("first")).filter("first IS NOT NULL").select(F.concat_ws(" ", "last", "first").alias("bigram"))
    ranges = sorted((r["range_no"], r["first"], r["last"]) for r in held.groupBy("range_no").agg(F.min_by("first", order).alias("first"), F.max_by("last", order).alias("last")).collect())
    met = [(f"{a[2]} {b[1]}",) for a, b in zip(ranges, ranges[1:], strict=False)]
    return inside.unionByName(words.sparkSession.createDataFrame(met, "bigram string"))


def eval_fractions(df: DataFrame, family: str = "family", split: str = "split", least: float = 0.09) -> DataFrame:
    """Both splits' counts by conditional sums (no outer join of two counts)."""
    out = df.groupBy(family).agg(F.count_if(F.col(split) == "train").alias("n_train"), F.count_if(F.col(split) == "eval").alias("n_eval"))
    share = F.col("n_eval") / (F.col("n_train") + F.col("n_eval"))
    return out.withColumn("eval_fraction", share).withColumn("low", share < least)


def topic_overlap(df: DataFrame, family: str = "family", topic: str = "topic", split: str = "split") -> DataFrame:
    """Topics per family that occur in train, in eval and in both, from one aggregate."""
    per = df.filter(F.col(topic).isNotNull()).groupBy(family, topic).agg(F.bool_or(F.col(split) == "train").alias("t"), F.bool_or(F.col(split) == "eval").alias("e"))
    return per.groupBy(family).agg(F.count_if("t").alias("train_topics"), F.count_if("e").alias("eval_topics"), F.count_if(F.col("t") & F.col("e")).alias("shared_topics"))


def census(df: DataFrame, family: str = "family", topic: str = "topic") -> DataFrame:
    """Rows per family and topic, per family and in all."""
    return df.rollup(family, topic).agg(F.count("*").alias("n"), F.grouping_id().alias("level"))


def shares(df: DataFrame, family: str, bucket: str) -> DataFrame:
    """Counts and percentages per family, per bucket and in all."""
    own = df.groupBy(bucket, family).agg(F.count("*").alias("n"))
    own = own.groupingSets([[family], [bucket], []], family, bucket).agg(F.sum("n").alias("n"), F.grouping_id().alias("level"))
    whole = F.max(F.when(F.col("level") == 3, F.col("n"))).over(Window.partitionBy())
    return own.withColumn("percent", F.round(100.0 * F.col("n") / whole, 6))


def first_examples(df: DataFrame, *by: str, order: str = "seq", value: str = "id") -> DataFrame:
    return df.groupBy(*by).agg(F.min_by(value, order).alias("example"))


def duplicates_across(df: DataFrame, key: str = "key", split: str = "split") -> DataFrame:
    """How many keys repeat within a split and across splits."""
    per = df.groupBy(key).agg(F.count_if(F.col(split) == "train").alias("t"), F.count_if(F.col(split) == "eval").alias("e"))
    zero = F.lit(0).cast("long")
    return per.agg(
        F.coalesce(F.sum(F.greatest(F.col("t") - 1, zero)), zero).alias("within_train"),
        F.coalesce(F.sum(F.greatest(F.col("e") - 1, zero)), zero).alias("within_eval"),
        F.count_if((F.col("t") > 0) & (F.col("e") > 0)).alias("across"),
    )


def gate(df: DataFrame, least_eval: float = 0.09) -> DataFrame:
    """(check, value, passed) over rows with family, split, tier, sourced, options, probs, correct_index and key."""
    kind = probability_class()
    one = df.agg(
        F.count_if(F.size("options") < 8).alias("fewer_than_8_options"),
        F.count_if(kind == "bad_sum").alias("bad_probabilities"),
        F.count_if(kind == "gold_low").alias("gold_below_half"),
        F.count_if(kind == "na_gold").alias("padding_as_gold"),
        F.count_if(F.col("tier").isNull()).alias("missing_tier"),
        F.count_if((F.col("tier") == "fact") & ~F.col("sourced")).alias("facts_without_source"),
    )
    names = one.columns
    rows = one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("check"), F.col(n).cast("long").alias("value")) for n in names])).alias("r")).select("r.*")
    low = eval_fractions(df, least=least_eval).agg(F.count_if("low").alias("value")).select(F.lit("families_short_of_eval").alias("check"), "value")
    dup = duplicates_across(df).select(F.lit("keys_across_splits").alias("check"), F.col("across").alias("value"))
    free = F.col("check").isin("fewer_than_8_options")  # informational unless it is required
    return rows.unionByName(low).unionByName(dup).withColumn("passed", (F.col("value") == 0) | free)


def verdict(checks: DataFrame) -> DataFrame:
    return checks.agg(F.bool_and("passed").alias("passed"), F.count_if(~F.col("passed")).alias("n_failed"))


def example_row(probs: str = "probs") -> Column:
    """A row as five lines of a list: question, options, gold with its probability, context, tier and source."""
    gold = F.get("options", F.col("correct_index"))
    options = F.array_join(F.transform("options", lambda o, i: F.concat(i.cast("string"), F.lit(". "), o)), " | ")
    share = F.coalesce(F.call_function("format_number", F.get(probs, F.col("correct_index")), F.lit("0.00")), F.lit("?"))  # null stays null, ties to even
    said = lambda c: F.coalesce(c.cast("string"), F.lit("None"))
    return F.concat_ws(
        "\n",
        F.concat(F.lit("  - **question:** "), shortened("question", 140)),
        F.concat(F.lit("    options: "), shortened(options, 170)),
        F.concat(F.lit("    correct: idx="), said(F.col("correct_index")), F.lit(" → "), F.when(gold.isNull(), "?").otherwise(shortened(gold, 70)), F.lit(" (gold="), share, F.lit(")")),
        F.concat(F.lit("    context: "), shortened("context", 150)),
        F.concat(F.lit("    tier="), said(F.col("tier")), F.lit(" source="), said(F.col("generated_by"))),
    )


def census_report(df: DataFrame, bucket: Column, title: str = "Corpus") -> str:
    """The census in sections: totals, families, buckets, and each family's topics with an example row.

    ``df``: family, topic, split, seq, id and what ``example_row`` reads. Only tables of families and topics reach the driver.
    """
    of = lambda split: F.count_if(F.col("split") == split).alias(split)
    topics = df.groupBy("family", F.coalesce("topic", F.lit("(none)")).alias("topic")).agg(of("train"), of("eval")).collect()
    first = first_examples(df, "family").select("example")
    shown = {r["family"]: r["shown"] for r in df.join(first, F.col("id") == F.col("example"), "left_semi").select("family", example_row().alias("shown")).collect()}
    named = {r["family"]: r["bucket"] for r in df.select("family").distinct().withColumn("bucket", bucket).collect()}
    families: dict[str, list[int]] = {}
    for r in topics:
        n = families.setdefault(r["family"], [0, 0])
        n[0], n[1] = n[0] + r["train"], n[1] + r["eval"]
    total = [sum(n[k] for n in families.values()) for k in (0, 1)]

    def line(name: str, n: list[int]) -> str:
        return f"| {name} | " + " | ".join(f"{x:,} | {100 * x / t if t else 0:.2f}%" for x, t in zip(n, total, strict=True)) + " |"

    order = sorted(families, key=lambda f: (-sum(families[f]), f))
    out = [f"# {title}", "", f"- train: {total[0]:,} rows", f"- eval: {total[1]:,} rows", "", "## Families", "", "| family | bucket | train | % | eval | % |", "|---|---|---:|---:|---:|---:|"]
    out += [line(f"{f} | {named[f]}", families[f]) for f in order]
    out += ["", "## Buckets", "", "| bucket | train | % | eval | % |", "|---|---:|---:|---:|---:|"]
    for b in sorted(set(named.values())):
        out.append(line(b, [sum(families[f][k] for f in order if named[f] == b) for k in (0, 1)]))
    for f in order:
        own = sorted((r for r in topics if r["family"] == f), key=lambda r: (-r["train"] - r["eval"], r["topic"]))
        out += ["", f"## {f}", "", shown.get(f, ""), "", f"{len(own)} topics", "", "| topic | train | eval |", "|---|---:|---:|"]
        out += [f"| {r['topic']} | {r['train']:,} | {r['eval']:,} |" for r in own]
    return "\n".join(out) + "\n"


def counted(df: DataFrame, **counters: Column) -> tuple[DataFrame, Observation]:
    """``df`` with run counters (rows for which each condition holds), filled by the first action on it; no pass of its own."""
    seen = Observation()
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *[F.count_if(c).alias(name) for name, c in counters.items()]), seen


def markdown(census_rows: DataFrame, title: str = "Census") -> str:
    """A table of a small report (one row per family)."""
    names = census_rows.columns
    lines = [f"# {title}", "", "| " + " | ".join(names) + " |", "|" + "-|" * len(names)]
    lines += ["| " + " | ".join("" if v is None else str(v) for v in row) + " |" for row in census_rows.toLocalIterator()]
    return "\n".join(lines) + "\n"
