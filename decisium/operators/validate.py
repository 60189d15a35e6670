"""Row validation, flags and the reject cascade."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from decisium.functions.arrays import default_probs, gold_probability, renormalised, total
from decisium.functions.text import collapsed, stripped, text_of

LEAST_OPTIONS, MOST_OPTIONS = 2, 8

# fixed values: spellings of "no answer"
NA_SPELLINGS = ("n/a", "na", "n a", "not available", "not-available", "none", "nil", "unknown", "no answer")

# fixed values: all families; others are treated as "unknown"
KNOWN_FAMILIES = (
    "retrieval", "paraphrase", "order", "ambiguity", "permuted",
    "numeric", "spatial", "compare", "oddoneout", "category", "property", "negation", "conditional",
    "define", "analogy", "cause", "summary", "tone", "intent", "knowledge", "consistency",
    "wiki_fact",
    "arithmetic", "counting", "sets", "beforeafter", "ordinal", "sequence_next",
    "timeclock", "dates", "negprop", "synonym", "antonym", "transitivity", "distribution",
    "wikicat", "wikibox", "wikiret",
    "openbookqa", "sciq", "commonsense", "hellaswag", "medqa",
    "open", "longread",
    "chain_arithmetic", "chain_logic", "chain_sequence", "chain_retrieval",
    "reformulate", "near_miss", "noise",
    "quality_qa", "qasc", "medmcqa", "mmlu", "gsm_mc", "math_mc",
    "arc-challenge", "mmlu-astronomy", "race-middle",
)

# fixed values: families that assert facts and must say where from
FACT_FAMILIES = (
    "wiki_fact",
    "openbookqa", "sciq", "commonsense", "hellaswag", "medqa",
    "quality_qa", "qasc", "medmcqa", "mmlu", "gsm_mc", "math_mc",
    "arc-challenge", "mmlu-astronomy", "race-middle",
)


def na_padding(c) -> Column:
    """Blank or a spelling of "no answer"; the exact ``Na`` is an answer."""
    t = stripped(c)
    return (t == "") | ((t != "Na") & F.lower(t).isin(*NA_SPELLINGS))


# fixed values: what makes a row read like a fact
FACT_YEAR = r"(?U)\b(?:1[5-9]\d{2}|20[0-2]\d)\b"
FACT_NAMES = r"(?U)[A-Z][A-Za-z']+(?:[\s-]+[A-Z][A-Za-z']+){1,}"


def fact_flag(context, question) -> Column:
    """Both a year from 1500 to 2029 and two capitalised words in a row; nulls are empty."""
    t = F.concat_ws(" ", text_of(context), text_of(question))
    return t.rlike(FACT_YEAR) & t.rlike(FACT_NAMES)


def known_family(c) -> Column:
    f = F.col(c) if isinstance(c, str) else c
    return F.when(f.isin(*KNOWN_FAMILIES), f).otherwise("unknown")


def has_source(*fields: Column) -> Column:
    return F.coalesce(*[F.nullif(stripped(f), F.lit("")) for f in fields]).isNotNull()


def errors(context="context", question="question", options="options", gold="correct_index") -> Column:
    """array<string> of the broken rules of a typed row; all rules are checked."""
    n = F.size(options)
    rules = [
        (F.col(context).isNull(), "context is not a string"),
        (F.col(question).isNull() | (collapsed(question) == ""), "question is blank"),
        (F.col(options).isNull() | (n < LEAST_OPTIONS) | (n > MOST_OPTIONS), "options are not 2 to 8"),
        (F.coalesce(F.exists(options, lambda o: o.isNull() | (collapsed(o) == "")), F.lit(False)), "an option is blank"),
        (F.col(gold).isNotNull() & ((F.col(gold) < 0) | (F.col(gold) >= F.coalesce(n, F.lit(0)))), "correct_index is out of range"),
    ]
    return F.filter(F.array(*[F.when(cond, F.lit(text)) for cond, text in rules]), lambda e: e.isNotNull())


def probability_error(probs, n) -> Column:
    """What is wrong with given probabilities, or null; absent ones are fine."""
    p = F.col(probs) if isinstance(probs, str) else probs
    n = F.col(n) if isinstance(n, str) else n
    return F.when(p.isNull(), F.lit(None)).when(F.size(p) != n, "teacher_probs have another length").when(~(total(p) > 0), "teacher_probs don't add up")


def final_probs(probs, n, gold) -> Column:
    """Given probabilities rescaled to 1, else the default ones."""
    return F.coalesce(renormalised(probs), default_probs(n, gold))


def validate_json(df: DataFrame, column: str = "value") -> DataFrame:
    """``df`` with row (the canonical row, null if invalid) and errors (joined by "; ", null if valid).

    Types are checked on the parsed value, so ``true`` is no index and a number no text.
    Unknown top-level fields are dropped; those of meta and label_source are kept as JSON.
    """
    v = F.try_parse_json(column)
    df = df.withColumn("v", v)
    kind = lambda path: F.schema_of_variant(F.try_variant_get("v", path, "variant"))
    text = lambda path: F.try_variant_get("v", path, "string")
    item_kinds = F.transform(F.coalesce(F.try_variant_get("v", "$.options", "array<variant>"), F.array().cast("array<variant>")), lambda o: F.schema_of_variant(o))
    df = df.withColumns(
        {
            "k_context": kind("$.context"),
            "k_question": kind("$.question"),
            "k_options": kind("$.options"),
            "k_items": item_kinds,
            "k_gold": kind("$.correct_index"),
            "context": text("$.context"),
            "question": text("$.question"),
            "options": F.when(F.startswith(kind("$.options"), F.lit("ARRAY")), F.try_variant_get("v", "$.options", "array<string>")),
            "gold": F.when(kind("$.correct_index") == "BIGINT", F.try_variant_get("v", "$.correct_index", "int")),
            "probs": F.try_variant_get("v", "$.teacher_probs", "array<double>"),
            "family": F.coalesce(text("$.meta.family"), text("$.task"), F.lit("unknown")),
        }
    )
    n = F.coalesce(F.size("options"), F.lit(0))
    is_null = F.coalesce(F.col("k_gold"), F.lit("VOID")) == "VOID"
    rules = [
        (F.col("v").isNull(), "not a JSON object"),
        (F.coalesce(F.col("k_context"), F.lit("")) != "STRING", "context is not a string"),
        ((F.coalesce(F.col("k_question"), F.lit("")) != "STRING") | (collapsed("question") == ""), "question is blank"),
        (F.col("options").isNull() | (n < LEAST_OPTIONS) | (n > MOST_OPTIONS), "options are not 2 to 8"),
        (F.exists("k_items", lambda k: k != "STRING") | F.coalesce(F.exists("options", lambda o: o.isNull() | (collapsed(o) == "")), F.lit(False)), "an option is blank"),
        (~is_null & (F.col("gold").isNull() | (F.col("gold") < 0) | (F.col("gold") >= n)), "correct_index is out of range"),
    ]
    found = F.filter(F.array(*[F.when(F.coalesce(cond, F.lit(True)), F.lit(t)) for cond, t in rules]), lambda e: e.isNotNull())
    later = F.coalesce(probability_error("probs", n), _provenance_error())
    df = df.withColumn("errors", F.when(F.size(found) > 0, F.array_join(found, "; ")).otherwise(later))
    tier = F.coalesce(text("$.meta.tier"), F.when(known_family("family").isin(*FACT_FAMILIES), "fact").otherwise("shape"))
    row = F.struct(
        F.coalesce(text("$.id"), F.sha2(F.concat_ws("\x1e", "context", "question", F.array_join("options", "\x1f")), 256)).alias("id"),
        F.coalesce(text("$.task"), known_family("family")).alias("task"),
        F.coalesce(text("$.difficulty"), F.lit("medium")).alias("difficulty"),
        stripped("context").alias("context"),
        stripped("question").alias("question"),
        F.transform("options", stripped).alias("options"),
        F.col("gold").alias("correct_index"),
        final_probs("probs", n, "gold").alias("teacher_probs"),
        F.struct(
            F.coalesce(text("$.label_source.model"), F.lit("unknown-model")).alias("model"),
            F.coalesce(F.try_variant_get("v", "$.label_source.temperature", "double"), F.lit(0.7)).alias("temperature"),
            F.coalesce(F.try_variant_get("v", "$.label_source.n_samples", "int"), F.lit(1)).alias("n_samples"),
            F.coalesce(text("$.label_source.vote"), F.lit("direct")).alias("vote"),
        ).alias("label_source"),
        F.struct(
            F.col("family"),
            tier.alias("tier"),
            F.when(tier == "fact", F.coalesce(F.try_variant_get("v", "$.meta.fact_flagged", "boolean"), F.lit(False))).otherwise(fact_flag("context", "question")).alias("fact_flagged"),
            *[text(f"$.meta.{k}").alias(k) for k in ("generated_by", "source_page", "dataset", "support_span", "source", "topic", "source_topic", "split_with")],
            F.to_json(F.try_variant_get("v", "$.meta", "variant")).alias("all"),
        ).alias("meta"),
    )
    helpers = ("v", "k_context", "k_question", "k_options", "k_items", "k_gold", "context", "question", "options", "gold", "probs", "family")
    return df.withColumn("row", F.when(F.col("errors").isNull(), row)).drop(*helpers)


def _provenance_error() -> Column:
    given = F.coalesce(F.try_variant_get("v", "$.meta.tier", "string"), F.when(known_family("family").isin(*FACT_FAMILIES), "fact").otherwise("shape"))
    sources = has_source(*[F.try_variant_get("v", f"$.meta.{k}", "string") for k in ("source_page", "dataset", "support_span", "source")])
    return F.when((given == "fact") & ~sources, F.lit("a fact row names no source"))


def gold_too_low(probs, gold, least: float = 0.5) -> Column:
    return F.coalesce(gold_probability(probs, gold) < least, F.lit(False))


def gold_is_padding(options, gold) -> Column:
    g = F.get(F.col(options) if isinstance(options, str) else options, F.col(gold) if isinstance(gold, str) else gold)
    return F.coalesce(na_padding(g) & g.isNotNull(), F.lit(False))


def first_reason(rules: list[tuple[str, Column]]) -> Column:
    """The name of the first rule that a row breaks, else null."""
    out = None
    for name, cond in rules:
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out


def near_miss_ok(ratio: Column, new: Column, old: Column) -> Column:
    """Similar but not the same: ratio from 0.30 to 0.95, lengths within a factor of four."""
    lengths = F.length(new) / F.greatest(F.length(old), F.lit(1))
    return (ratio < 0.999) & ratio.between(0.30, 0.95) & lengths.between(0.25, 4)


def accept_reformulation(new_q, old_q, new_options, old_options, new_gold, old_gold) -> Column:
    """Another question, the same options under normalisation, the same gold."""
    from decisium.functions.text import normal

    same = F.transform(new_options, normal) == F.transform(old_options, normal)
    return (normal(new_q) != normal(old_q)) & same & new_gold.eqNullSafe(old_gold)


def filler_ok(filler: Column, options: Column) -> Column:
    """No option occurs in the filler."""
    from decisium.functions.text import normal

    return ~F.exists(options, lambda o: F.contains(normal(filler), normal(o)))


