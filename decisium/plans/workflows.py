"""Whole runs: merge, gate, rebalance, census, public export, scoring of single questions, evaluation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from decisium.operators import audit, keys, merge, metrics, replies, validate
from decisium.plans.base import PREDICTED, ROWS, decision_rows, joined, n1, n2, predicted_rows, query
from decisium.runtime import materialise, table


def merge_corpus(current: DataFrame, new: DataFrame, reserved: DataFrame, eval_fraction: float = 0.1, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(accepted new rows with is_eval, (id, reason) of the others).

    Reserved questions must not be in ``current`` (an error). New rows pass a cascade:
    valid, not reserved, not known by question, no unsourced fact, gold probable and
    no padding, first of their key. Accepted rows get unique ids and are split per family.
    """
    current = current.withColumn("key", keys.row_key()).withColumn("qkey", keys.question_key())
    reserved = reserved.withColumn("qkey", keys.question_key())
    merge.require_no_leak(current, reserved, "qkey")
    rows = new.withColumn("key", keys.row_key()).withColumn("qkey", keys.question_key())
    guard = reserved.select(F.col("qkey").alias("q1")).distinct()
    known = current.select(F.col("qkey").alias("q2")).distinct()
    rows = rows.join(guard, F.col("qkey") == F.col("q1"), "left").join(known, F.col("qkey") == F.col("q2"), "left")
    reason = validate.first_reason(
        [
            ("invalid", F.size(validate.errors()) > 0),
            ("public", F.col("q1").isNotNull()),
            ("existing", F.col("q2").isNotNull()),
            ("fact_flag", F.coalesce(F.col("fact_flagged"), F.lit(False))),
            ("gold_low", validate.gold_too_low("probs", "correct_index") if "probs" in new.columns else F.lit(False)),
            ("na_gold", validate.gold_is_padding("options", "correct_index")),
        ]
    )
    held = materialise(rows.withColumn("reason", reason).drop("q1", "q2"), "cascade")
    good = held.filter("reason is null")
    first = merge.first_per_key(good, "key")
    dropped = held.filter("reason is not null").select("id", "reason")
    repeats = good.join(first.select(F.col("seq").alias("first_seq")), F.col("seq") == F.col("first_seq"), "left_anti").select("id", F.lit("duplicate").alias("reason"))
    accepted = merge.split_by_topic(merge.suffixed_ids(first.drop("reason"), current), eval_fraction, seed)
    return accepted, dropped.unionByName(repeats)


def export_public(rows: DataFrame, family: str, salt: str, fraction: float = 0.5) -> DataFrame:
    """Rows with a gold option and two options or more, tagged with their half."""
    from decisium.sources.records import accepted, canonical, halves

    return halves(canonical(accepted(rows), family), family, salt, fraction)


def once_per_context(df: DataFrame, context: str, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``df`` with what ``compute`` derives from a context, computed once for each distinct one.

    ``compute`` takes and keeps (context_key, context); contexts meet their rows by hash.
    """
    keyed = df.withColumn("context_key", F.sha2(F.coalesce(context, F.lit("")), 256))
    distinct = keyed.select("context_key", F.col(context).alias("context")).dropDuplicates(["context_key"])
    found = compute(distinct).drop("context").withColumnRenamed("context_key", "found_key")
    return keyed.join(found, F.col("context_key") == F.col("found_key")).drop("context_key", "found_key")


def ask(spark: SparkSession, context: str, question: str, options: list[str], score: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Ranked options of a single question; ``score`` adds probs."""
    one = spark.createDataFrame([("ask", context, question, options)], "id string, context string, question string, options array<string>")
    ranked = metrics.ranked_options(score(one), "id")
    from decisium.functions.text import bar

    return ranked.withColumn("bar", bar("p")).orderBy("rank")


def cycled(values: list, index: Column) -> Column:
    """The value whose turn it is."""
    return F.get(F.array(*[F.lit(v) for v in values]), F.pmod(index, F.lit(len(values))).cast("int"))


def overlaid(base: Column, over: Column) -> Column:
    """The map ``over`` laid on ``base``: its entries win."""
    return F.map_concat(F.map_filter(base, lambda k, v: ~F.map_contains_key(over, k)), over)


def supported(rows: DataFrame) -> DataFrame:
    """Reply rows that say what supports them, with the question valid."""
    return rows.filter((F.trim(F.coalesce("support_span", F.lit(""))) != "") & F.coalesce(F.size("new_options").between(2, 8), F.lit(False)))


@query(
    "orc_merge",
    f"""WITH {ROWS}, q AS (SELECT *, sha256(concat_ws(chr(30), {n1("context")}, {n1("question")}, {joined(n1)})) AS key, sha256(concat_ws(chr(30), {n1("question")}, {joined(n1)})) AS qkey FROM rows0),
cur AS (SELECT * FROM q WHERE family IN ('src0', 'src1') AND len(options) = 4), res AS (SELECT * FROM q WHERE family = 'src2' AND len(options) = 8),
new AS (SELECT * FROM q WHERE family NOT IN ('src0', 'src1', 'src2')),
c AS (SELECT *, CASE WHEN NOT ({n2("question")} <> '' AND len(options) BETWEEN 2 AND 8 AND coalesce(correct_index BETWEEN 0 AND len(options) - 1, true)) THEN 'invalid'
  WHEN qkey IN (SELECT qkey FROM res) THEN 'public' WHEN qkey IN (SELECT qkey FROM cur) THEN 'existing' WHEN fact_flagged THEN 'fact_flag' END AS reason FROM new),
r AS (SELECT *, CASE WHEN reason IS NULL THEN row_number() OVER (PARTITION BY reason, key ORDER BY seq) END AS rn FROM c)
SELECT coalesce(reason, CASE WHEN rn > 1 THEN 'duplicate' ELSE 'accepted' END) AS outcome, count(*) AS n FROM r GROUP BY 1""",
)
def orc_merge(spark, sf_dir):
    """How a merge of all documents' rows ends, by outcome."""
    df = decision_rows(spark, sf_dir)
    current = df.filter(F.col("family").isin("src0", "src1") & (F.size("options") == 4))
    reserved = df.filter((F.col("family") == "src2") & (F.size("options") == 8))
    accepted, others = merge_corpus(current, df.filter(~F.col("family").isin("src0", "src1", "src2")), reserved)
    every = accepted.select("id", F.lit("accepted").alias("outcome")).unionByName(others.withColumnRenamed("reason", "outcome"))
    return every.groupBy("outcome").agg(F.count("*").alias("n"))


@query("orc_gate", f"""WITH {ROWS}, e AS (SELECT count(*) FILTER (WHERE s < 0.09) AS low FROM (SELECT count(*) FILTER (WHERE split = 'eval') / CAST(count(*) AS DOUBLE) AS s FROM rows0 GROUP BY family)),
k AS (SELECT count(*) AS x FROM (SELECT 1 FROM rows0 GROUP BY {n1("context")}, {joined(n1)} HAVING bool_or(split = 'train') AND bool_or(split = 'eval'))),
f AS (SELECT count(*) FILTER (WHERE family IN ('src1', 'src2') AND seq % 3 = 0) AS unsourced FROM rows0),
p AS (SELECT count(*) FILTER (WHERE probs[correct_index + 1] < 0.5) AS gl FROM (WITH {PREDICTED} SELECT probs, correct_index FROM predicted))
SELECT low = 0 AND x = 0 AND unsourced = 0 AND gl = 0 AS passed, CAST((low > 0)::INT + (x > 0)::INT + (unsourced > 0)::INT + (gl > 0)::INT AS BIGINT) AS n_failed FROM e, k, f, p""")
def orc_gate(spark, sf_dir):
    from decisium.plans.rows import gate_checks

    return audit.verdict(gate_checks(spark, sf_dir))


@query("orc_rebalance", f"""WITH {ROWS}, c AS (SELECT family, count(*) AS n, count(*) FILTER (WHERE split = 'eval') AS e, count(*) FILTER (WHERE split = 'train') AS t FROM rows0 GROUP BY family)
SELECT family, greatest(e, CASE WHEN t > 0 THEN least(n, CAST(round_even(n * 0.3::DOUBLE, 0) AS BIGINT) + 1) ELSE e END) AS n_eval FROM c""")
def orc_rebalance(spark, sf_dir):
    df = merge.rebalance(decision_rows(spark, sf_dir).select("id", "family", "split"), 0.3)
    return df.groupBy("family").agg(F.count_if(F.col("split") == "eval").alias("n_eval"))


@query("orc_census", f"WITH {ROWS} SELECT family, count(*) AS n, count(DISTINCT topic) AS n_topics, count(*) FILTER (WHERE split = 'eval') AS n_eval FROM rows0 GROUP BY family")
def orc_census(spark, sf_dir):
    """Rows, topics and eval rows per family: topics are counted in two steps, so no set of them is gathered."""
    per = decision_rows(spark, sf_dir).groupBy("family", "topic").agg(F.count("*").alias("n"), F.count_if(F.col("split") == "eval").alias("e"))
    return per.groupBy("family").agg(F.sum("n").alias("n"), F.count("topic").alias("n_topics"), F.sum("e").alias("n_eval"))


@query("orc_eval", f"""WITH {PREDICTED}, g AS (SELECT *, CASE WHEN list_position(probs, list_max(probs)) - 1 = correct_index THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS ok FROM predicted WHERE correct_index IS NOT NULL)
SELECT split, count(*) AS n, round(avg(ok), 9) AS accuracy FROM g GROUP BY split""")
def orc_eval(spark, sf_dir):
    df = metrics.scores(predicted_rows(spark, sf_dir).filter("correct_index is not null"), "split")
    return df.select("split", "n", F.round("accuracy", 9).alias("accuracy"))


@query("public_export", "SELECT lang AS topic, count(*) AS n FROM documents WHERE lang IN ('en', 'fr', 'de', 'es') GROUP BY lang")
def public_export(spark, sf_dir):
    """All rows with a gold option, exported with content ids and halves; counted by topic over both halves."""
    df = decision_rows(spark, sf_dir).withColumn("correct_index", F.coalesce("correct_index", F.lit(0)))
    out = export_public(df.select("seq", "context", "question", "options", "correct_index", "topic"), "open", "salt")
    return out.filter(F.col("pub_split").isin("train-half", "eval-half")).groupBy("topic").agg(F.count("*").alias("n"))


@query("context_reuse", f"WITH {ROWS} SELECT id, CAST(length(coalesce(context, '')) AS INT) AS n FROM rows0")
def context_reuse(spark, sf_dir):
    df = decision_rows(spark, sf_dir).select("id", "context")
    return once_per_context(df, "context", lambda c: c.withColumn("n", F.length("context"))).select("id", "n")


@query("ask_ranked", "SELECT * FROM (VALUES ('B', 'yes', 0.5::DOUBLE, 1, '###############'), ('A', 'no', 0.25::DOUBLE, 2, '########'), ('C', 'maybe', 0.25::DOUBLE, 3, '########')) t(letter, option, p, rank, bar)")
def ask_ranked(spark, sf_dir):
    out = ask(spark, "c", "q?", ["no", "yes", "maybe"], lambda d: d.withColumn("probs", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.25))))
    return out.select("letter", "option", "p", "rank", "bar")


@query("cycle_pick", "SELECT doc_id, ['x', 'y', 'z'][doc_id % 3 + 1] AS pick FROM documents")
def cycle_pick(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", cycled(["x", "y", "z"], F.col("doc_id")).alias("pick"))


@query("meta_overlay", "SELECT doc_id, lang AS a, 'old' AS b, source AS c FROM documents")
def meta_overlay(spark, sf_dir):
    base = F.create_map(F.lit("a"), F.lit("old"), F.lit("b"), F.lit("old"))
    over = F.create_map(F.lit("a"), F.col("lang"), F.lit("c"), F.col("source"))
    df = table(spark, sf_dir, "documents").select("doc_id", overlaid(base, over).alias("m"))
    return df.select("doc_id", *[F.col("m")[k].alias(k) for k in "abc"])


@query("supported_rows", "SELECT CAST(doc_id AS BIGINT) AS request_id FROM documents WHERE doc_id % 3 = 0")
def supported_rows(spark, sf_dir):
    """Reply rows that name a supporting span."""
    span = F.when(F.col("doc_id") % 3 == 0, F.lit("span")).when(F.col("doc_id") % 3 == 1, F.lit(" "))
    item = F.struct(F.lit("q").alias("question"), F.array(F.lit("a"), F.lit("b")).alias("options"), span.alias("support_span"))
    completions = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("request_id"), F.to_json(F.array(item)).alias("reply"))
    rows = replies.reply_rows(completions)
    return supported(rows.withColumns(replies.item_fields(F.col("item")))).select("request_id")


@query("family_caps", f"WITH {ROWS} SELECT family, least(count(*), 7) AS n FROM rows0 GROUP BY family")
def family_caps(spark, sf_dir):
    """A quota operator: at most seven rows of a family, in hash order."""
    df = decision_rows(spark, sf_dir).select("id", "family")
    limits = df.select("family").distinct().withColumn("most", F.lit(7))
    return merge.hash_first(df, "family", limits, "within", 7, "family", "id").filter("within").groupBy("family").agg(F.count("*").alias("n"))


@query("bounded_pool", "SELECT count(DISTINCT source) AS n FROM documents")
def bounded_pool(spark, sf_dir):
    from decisium.operators.mining import pool

    return pool(table(spark, sf_dir, "documents"), "source").select(F.size("pool").cast("long").alias("n"))


@query("first_match", f"WITH {ROWS}, q AS (SELECT id, seq, sha256(concat_ws(chr(30), {n1('question')}, {joined(n1)})) AS qkey FROM rows0) SELECT qkey, min_by(id, seq) AS id FROM q GROUP BY qkey")
def first_match(spark, sf_dir):
    """The first row of each question key."""
    q = decision_rows(spark, sf_dir).select("id", "seq", keys.question_key().alias("qkey"))
    return q.groupBy("qkey").agg(F.min_by("id", "seq").alias("id"))


@query("near_miss_gate")
def near_miss_gate(spark, sf_dir):
    """Which pairs of neighbouring turns pass the similarity gate."""
    from decisium.functions.text import similarity

    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    df = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", F.coalesce(before, F.lit("")).alias("before"))
    df = df.withColumn("ratio", similarity("before", "text"))
    return df.select("conv_id", "turn", validate.near_miss_ok(F.col("ratio"), F.col("text"), F.col("before")).alias("ok"))
