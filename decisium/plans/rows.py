"""Queries over decision rows: keys, validation, merge, split, audit."""

from __future__ import annotations

from pyspark.sql import functions as F

from decisium.functions import text as T
from decisium.functions.arrays import default_probs, renormalised
from decisium.functions.hashing import content_key, content_split, sha_mod
from decisium.operators import audit, keys, merge, validate
from decisium.plans.base import KEYED, PREDICTED, ROWS, decision_rows, joined, keyed_rows, n1, n2, predicted_rows, query
from decisium.runtime import materialise, table

GATE = f"""WITH {KEYED},
ranked AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq) AS rn FROM keyed
  WHERE context IS NOT NULL AND {n2("question")} <> '' AND len(options) BETWEEN 2 AND 8 AND coalesce(correct_index BETWEEN 0 AND len(options) - 1, true))
SELECT family, count(*) FILTER (WHERE rn = 1) AS n_rows, count(*) FILTER (WHERE rn = 1 AND split = 'eval') AS n_eval,
  round(count(*) FILTER (WHERE rn = 1 AND split = 'eval') / CAST(count(*) FILTER (WHERE rn = 1) AS DOUBLE), 9) AS eval_fraction,
  count(*) FILTER (WHERE rn = 1 AND len(options) < 8) AS n_lt8, count(*) FILTER (WHERE rn > 1) AS dup_count,
  count(*) FILTER (WHERE rn = 1 AND split = 'eval') >= 0.09 * count(*) FILTER (WHERE rn = 1) AS ok
FROM ranked GROUP BY family"""


@query("m0_gate_family", GATE)
def m0_gate_family(spark, sf_dir):
    """Validated rows, deduplicated in arrival order, and each family's gate figures."""
    valid = keyed_rows(spark, sf_dir).filter(F.size(validate.errors()) == 0).select("family", "split", "seq", "key", F.size("options").alias("n"))
    valid = materialise(valid, "valid")  # texts are read and normalised once
    first = valid.groupBy("key").agg(F.min("seq").alias("first_seq"))
    df = valid.join(first.select("first_seq"), F.col("seq") == F.col("first_seq"), "left").withColumn("is_first", F.col("first_seq").isNotNull())
    rows, evals = F.count_if("is_first"), F.count_if(F.col("is_first") & (F.col("split") == "eval"))
    return df.groupBy("family").agg(
        rows.alias("n_rows"),
        evals.alias("n_eval"),
        F.round(evals / rows.cast("double"), 9).alias("eval_fraction"),
        F.count_if(F.col("is_first") & (F.col("n") < 8)).alias("n_lt8"),
        F.count_if(~F.col("is_first")).alias("dup_count"),
        (evals >= F.lit(0.09).cast("decimal(3,2)") * rows).alias("ok"),
    )


def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


@query("norm_n1", f"SELECT doc_id, sha256({n1('text')}) AS norm FROM documents")
def norm_n1(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.sha2(T.normal("text"), 256).alias("norm"))


@query("norm_n2", f"SELECT doc_id, sha256({n2('text')}) AS norm FROM documents")
def norm_n2(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.sha2(T.collapsed("text"), 256).alias("norm"))


@query("norm_n3", f"SELECT doc_id, sha256({n1('text')}) AS norm FROM documents")
def norm_n3(spark, sf_dir):
    """NFKC is the identity on these texts, so the SQL leaves it out."""
    return docs(spark, sf_dir).select("doc_id", F.sha2(T.model_text("text"), 256).alias("norm"))


@query("row_key", f"WITH {KEYED} SELECT id, key FROM keyed")
def row_key(spark, sf_dir):
    return keyed_rows(spark, sf_dir).select("id", "key")


@query("exact_row_key", f"WITH {ROWS} SELECT id, sha256(concat_ws(chr(30), {n2('context')}, {n2('question')}, {joined(n2)})) AS key FROM rows0")
def exact_row_key(spark, sf_dir):
    return decision_rows(spark, sf_dir).select("id", keys.exact_row_key().alias("key"))


@query("question_key", f"WITH {ROWS} SELECT id, sha256(concat_ws(chr(30), {n1('question')}, {joined(n1)})) AS key FROM rows0")
def question_key(spark, sf_dir):
    return decision_rows(spark, sf_dir).select("id", keys.question_key().alias("key"))


TOPIC_FIELDS = "CASE WHEN doc_id % 3 = 0 THEN '  ' ELSE lang END"


@query("topic_of", f"SELECT doc_id, coalesce(nullif({n1(TOPIC_FIELDS)}, ''), nullif({n1('source')}, '')) AS topic FROM documents")
def topic_of(spark, sf_dir):
    first = F.when(F.col("doc_id") % 3 == 0, F.lit("  ")).otherwise(F.col("lang"))
    return docs(spark, sf_dir).select("doc_id", keys.topic(first, F.col("source")).alias("topic"))


@query("census_topic", f"SELECT doc_id, coalesce(nullif({n2(TOPIC_FIELDS)}, ''), nullif({n2('NULL')}, ''), '(unset)') AS topic FROM documents")
def census_topic(spark, sf_dir):
    first = F.when(F.col("doc_id") % 3 == 0, F.lit("  ")).otherwise(F.col("lang"))
    return docs(spark, sf_dir).select("doc_id", keys.census_topic(first, F.lit(None).cast("string")).alias("topic"))


@query(
    "default_probs",
    f"""WITH {ROWS} SELECT id, unnest(range(0, len(options)))::INT AS place,
  unnest(list_transform(range(0, len(options)), lambda i: round(CASE WHEN correct_index IS NULL THEN 1.0::DOUBLE / len(options)
    WHEN i = correct_index THEN 0.95::DOUBLE ELSE 0.05::DOUBLE / (len(options) - 1) END, 9))) AS p FROM rows0""",
)
def default_probabilities(spark, sf_dir):
    return decision_rows(spark, sf_dir).select("id", F.posexplode(F.transform(default_probs(F.size("options"), "correct_index"), lambda p: F.round(p, 9))).alias("place", "p"))


@query(
    "renorm_probs",
    f"""WITH {ROWS}, w AS (SELECT id, list_transform(range(0, len(options)), lambda i: CAST((seq + i * 7) % 13 AS DOUBLE)) AS w FROM rows0)
SELECT id, unnest(range(0, len(w)))::INT AS place, unnest(list_transform(w, lambda x: round(x / list_sum(w), 9))) AS p FROM w WHERE list_sum(w) > 0""",
)
def renorm_probs(spark, sf_dir):
    w = F.transform(F.sequence(F.lit(0), F.size("options") - 1), lambda i: ((F.col("seq") + i * 7) % 13).cast("double"))
    df = decision_rows(spark, sf_dir).select("id", renormalised(w).alias("p")).filter("p is not null")
    return df.select("id", F.posexplode(F.transform("p", lambda p: F.round(p, 9))).alias("place", "p"))


BROKEN = """broken AS (SELECT id, seq, family, CASE WHEN seq % 11 = 1 THEN NULL ELSE context END AS context,
  CASE WHEN seq % 7 = 2 THEN '   ' ELSE question END AS question,
  CASE WHEN seq % 13 = 3 THEN options[1:1] WHEN seq % 17 = 4 THEN list_concat(options, [' ']) ELSE options END AS options,
  CASE WHEN seq % 19 = 5 THEN 9 WHEN seq % 23 = 6 THEN -1 ELSE correct_index END AS correct_index FROM rows0)"""
ERRORS = f"""concat_ws('; ', CASE WHEN context IS NULL THEN 'context is not a string' END, CASE WHEN {n2("question")} = '' THEN 'question is blank' END,
  CASE WHEN len(options) NOT BETWEEN 2 AND 8 THEN 'options are not 2 to 8' END,
  CASE WHEN len(list_filter(options, lambda x: {n2("x")} = '')) > 0 THEN 'an option is blank' END,
  CASE WHEN correct_index < 0 OR correct_index >= len(options) THEN 'correct_index is out of range' END)"""


def broken_rows(spark, sf_dir):
    """Decision rows with one fault or another in some of them."""
    s = F.col("seq")
    return decision_rows(spark, sf_dir).select(
        "id", "seq", "family",
        F.when(s % 11 == 1, None).otherwise(F.col("context")).alias("context"),
        F.when(s % 7 == 2, "   ").otherwise(F.col("question")).alias("question"),
        F.when(s % 13 == 3, F.slice("options", 1, 1)).when(s % 17 == 4, F.concat("options", F.array(F.lit(" ")))).otherwise(F.col("options")).alias("options"),
        F.when(s % 19 == 5, 9).when(s % 23 == 6, -1).otherwise(F.col("correct_index")).alias("correct_index"),
    )


@query("validate_errors", f"WITH {ROWS}, {BROKEN} SELECT id, {ERRORS} AS errors FROM broken")
def validate_errors(spark, sf_dir):
    return broken_rows(spark, sf_dir).select("id", F.array_join(validate.errors(), "; ").alias("errors"))


@query("validate_json_rows", f"WITH {ROWS}, {BROKEN} SELECT id, {ERRORS} AS errors FROM broken")
def validate_json_rows(spark, sf_dir):
    """The same faults found in JSON text."""
    rows = broken_rows(spark, sf_dir)
    value = F.to_json(F.struct("context", "question", "options", "correct_index", F.struct(F.lit("retrieval").alias("family")).alias("meta")))
    return validate.validate_json(rows.select("id", value.alias("value"))).select("id", F.coalesce("errors", F.lit("")).alias("errors"))


@query("fact_flag", r"""SELECT doc_id, regexp_matches(coalesce(text, '') || ' q', '\b(?:1[5-9][0-9]{2}|20[0-2][0-9])\b') AND regexp_matches(coalesce(text, '') || ' q', '[A-Z][A-Za-z'']+(?:[\s-]+[A-Z][A-Za-z'']+)+') AS flagged FROM documents""")
def fact_flag(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", validate.fact_flag(F.coalesce("text", F.lit("")), F.lit("q")).alias("flagged"))


NA_CASES = ["n/a", "N/A", " None ", "", "  ", "Na", "na", "NA", "nil", "Unknown", "no answer", "sodium", "n a", "not-available", "Not Available", "nothing"]


@query(
    "na_padding",
    f"""WITH c AS (SELECT unnest({NA_CASES!r}) AS t), d AS (SELECT doc_id, lang AS t FROM documents), u AS (SELECT -1 AS doc_id, t FROM c UNION ALL SELECT doc_id, t FROM d)
SELECT doc_id, t, trim(t) = '' OR (trim(t) <> 'Na' AND lower(trim(t)) IN ('n/a','na','n a','not available','not-available','none','nil','unknown','no answer')) AS is_na FROM u""",
)
def na_padding(spark, sf_dir):
    cases = spark.createDataFrame([(-1, t) for t in NA_CASES], "doc_id long, t string")
    every = cases.unionByName(docs(spark, sf_dir).select("doc_id", F.col("lang").alias("t")))
    return every.withColumn("is_na", validate.na_padding("t"))


REASONS = f"""WITH {ROWS}, {BROKEN}, p AS (SELECT b.*, {ERRORS} AS errors, sha256(concat_ws(chr(30), {n1("context")}, {n1("question")}, {joined(n1)})) AS key,
  sha256(concat_ws(chr(30), {n1("question")}, {joined(n1)})) AS qkey, (SELECT r.fact_flagged FROM rows0 r WHERE r.id = b.id) AS fact_flagged FROM broken b),
reserved AS (SELECT DISTINCT qkey FROM p WHERE family = 'src7' AND len(options) = 5),
c AS (SELECT *, CASE WHEN errors <> '' THEN 'invalid' WHEN qkey IN (SELECT qkey FROM reserved) THEN 'public' WHEN fact_flagged THEN 'fact_flag' END AS early FROM p),
k AS (SELECT *, CASE WHEN early IS NULL THEN row_number() OVER (PARTITION BY early, key ORDER BY seq) END AS rn FROM c)
SELECT id, coalesce(early, CASE WHEN rn > 1 THEN 'duplicate' ELSE 'accepted' END) AS reason FROM k"""


@query("reject_reason", REASONS)
def reject_reason(spark, sf_dir):
    """The first rule that turns a row away: invalid, reserved for public sets, fact flag, duplicate of an accepted row."""
    flags = decision_rows(spark, sf_dir).select(F.col("id").alias("flag_id"), "fact_flagged")
    df = broken_rows(spark, sf_dir).withColumn("errors", F.size(validate.errors()) > 0).withColumn("key", keys.row_key()).withColumn("qkey", keys.question_key())
    df = df.select("id", "seq", "family", "errors", "key", "qkey", F.size("options").alias("n")).join(flags, F.col("id") == F.col("flag_id"))
    reserved = df.filter((F.col("family") == "src7") & (F.col("n") == 5)).select(F.col("qkey").alias("reserved_key")).distinct()
    df = df.join(reserved, F.col("qkey") == F.col("reserved_key"), "left")
    early = validate.first_reason([("invalid", F.col("errors")), ("public", F.col("reserved_key").isNotNull()), ("fact_flag", F.col("fact_flagged"))])
    df = df.select("id", "seq", "key", early.alias("early"))
    first = df.filter("early is null").groupBy("key").agg(F.min("seq").alias("first_seq")).select("first_seq")
    df = df.join(first, F.col("seq") == F.col("first_seq"), "left")
    return df.select("id", F.coalesce("early", F.when(F.col("first_seq").isNull(), "duplicate").otherwise("accepted")).alias("reason"))


GUARDED = f"""WITH {KEYED}, q AS (SELECT *, sha256(concat_ws(chr(30), {n1("question")}, {joined(n1)})) AS qkey FROM keyed)"""


def questions(spark, sf_dir):
    return keyed_rows(spark, sf_dir).withColumn("qkey", keys.question_key())


@query("anti_public", f"{GUARDED} SELECT id FROM q WHERE qkey NOT IN (SELECT qkey FROM q WHERE family = 'src3' AND len(options) = 6)")
def anti_public(spark, sf_dir):
    q = questions(spark, sf_dir)
    return merge.without(q, q.filter((F.col("family") == "src3") & (F.size("options") == 6)), "qkey").select("id")


@query("anti_rowkey", f"{GUARDED} SELECT id FROM q WHERE split = 'train' AND key NOT IN (SELECT key FROM q WHERE split = 'eval')")
def anti_rowkey(spark, sf_dir):
    q = keyed_rows(spark, sf_dir)
    return merge.without(q.filter("split = 'train'"), q.filter("split = 'eval'"), "key").select("id")


@query("anti_eval_train", f"{GUARDED} SELECT id FROM q WHERE split = 'eval' AND key NOT IN (SELECT key FROM q WHERE split = 'train')")
def anti_eval_train(spark, sf_dir):
    q = keyed_rows(spark, sf_dir)
    return merge.without(q.filter("split = 'eval'"), q.filter("split = 'train'"), "key").select("id")


@query("anti_existing", f"{GUARDED} SELECT id FROM q WHERE family <> 'src1' AND qkey NOT IN (SELECT qkey FROM q WHERE family = 'src1' AND len(options) < 6)")
def anti_existing(spark, sf_dir):
    q = questions(spark, sf_dir)
    return merge.without(q.filter("family <> 'src1'"), q.filter((F.col("family") == "src1") & (F.size("options") < 6)), "qkey").select("id")


@query("semi_leak", f"{GUARDED} SELECT id FROM q WHERE split = 'train' AND key IN (SELECT key FROM q WHERE split = 'eval')")
def semi_leak(spark, sf_dir):
    q = keyed_rows(spark, sf_dir)
    return merge.within(q.filter("split = 'train'"), q.filter("split = 'eval'"), "key").select("id")


@query("dedup_first", f"WITH {KEYED} SELECT id, key FROM keyed QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq) = 1")
def dedup_first(spark, sf_dir):
    return merge.first_per_key(keyed_rows(spark, sf_dir), "key").select("id", "key")


@query("dedup_count", f"WITH {KEYED}, p AS (SELECT key, count(*) FILTER (WHERE split = 'train') AS t, count(*) FILTER (WHERE split = 'eval') AS e FROM keyed GROUP BY key) SELECT CAST(sum(greatest(t - 1, 0)) AS BIGINT) AS within_train, CAST(sum(greatest(e - 1, 0)) AS BIGINT) AS within_eval, count(*) FILTER (WHERE t > 0 AND e > 0) AS across FROM p")
def dedup_count(spark, sf_dir):
    return audit.duplicates_across(keyed_rows(spark, sf_dir))


@query(
    "id_decollide",
    """WITH c AS (SELECT doc_id AS seq, source || '-' || lang AS id FROM documents), e AS (SELECT DISTINCT id FROM c WHERE seq % 10 = 0),
r AS (SELECT c.seq, c.id, row_number() OVER (PARTITION BY c.id ORDER BY c.seq) + CASE WHEN e.id IS NULL THEN 0 ELSE 1 END AS n FROM c LEFT JOIN e ON c.id = e.id)
SELECT seq, CASE WHEN n > 1 THEN id || '#' || n ELSE id END AS id FROM r""",
)
def id_decollide(spark, sf_dir):
    df = docs(spark, sf_dir).select(F.col("doc_id").alias("seq"), F.concat_ws("-", "source", "lang").alias("id"))
    return merge.suffixed_ids(df, df.filter(F.col("seq") % 10 == 0)).select("seq", "id")


@query(
    "split_fraction",
    f"""WITH {ROWS} SELECT id, row_number() OVER (PARTITION BY family ORDER BY sha256('7|' || family || '|' || id), id)
  <= greatest(1, CAST(round_even(count(*) OVER (PARTITION BY family) * 0.1::DOUBLE, 0) AS BIGINT)) AS is_eval FROM rows0""",
)
def split_fraction(spark, sf_dir):
    return merge.split_by_fraction(decision_rows(spark, sf_dir).select("id", "family"), 0.1).select("id", "is_eval")


TOPICS = """t AS (SELECT id, family, CASE WHEN seq % 5 = 0 THEN NULL ELSE topic END AS topic FROM rows0),
tot AS (SELECT family, greatest(1, CAST(round_even(count(*) * 0.15::DOUBLE, 0) AS BIGINT)) AS target FROM t GROUP BY family),
s AS (SELECT family, topic, count(*) AS n FROM t WHERE topic IS NOT NULL GROUP BY family, topic),
c AS (SELECT s.*, target, coalesce(sum(n) OVER (PARTITION BY s.family ORDER BY sha256('7|' || s.family || '|' || topic), topic ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < target AS e FROM s JOIN tot USING (family)),
d AS (SELECT tot.family, greatest(0, any_value(target) - coalesce(sum(CASE WHEN e THEN n END), 0)) AS deficit FROM tot LEFT JOIN (SELECT family, e, n FROM c) c USING (family) GROUP BY tot.family)"""


@query(
    "split_topic_disjoint",
    f"""WITH {ROWS}, {TOPICS}
SELECT id, e AS is_eval FROM t JOIN c ON t.family = c.family AND t.topic = c.topic
UNION ALL SELECT id, row_number() OVER (PARTITION BY t.family ORDER BY sha256('7|' || t.family || '|' || id), id) <= deficit FROM t JOIN d ON t.family = d.family WHERE topic IS NULL""",
)
def split_topic_disjoint(spark, sf_dir):
    df = decision_rows(spark, sf_dir).select("id", "family", F.when(F.col("seq") % 5 == 0, None).otherwise(F.col("topic")).alias("topic"))
    return merge.split_by_topic(df, 0.15).select("id", "is_eval")


@query(
    "split_forced",
    f"""WITH {ROWS}, f AS (SELECT id, family, CASE seq % 6 WHEN 0 THEN 'train' WHEN 1 THEN 'eval' END AS side FROM rows0)
SELECT id, side = 'eval' AS is_eval FROM f WHERE side IS NOT NULL
UNION ALL SELECT id, row_number() OVER (PARTITION BY family ORDER BY sha256('7|' || family || '|' || id), id)
  <= greatest(1, CAST(round_even(count(*) OVER (PARTITION BY family) * 0.1::DOUBLE, 0) AS BIGINT)) FROM f WHERE side IS NULL""",
)
def split_forced(spark, sf_dir):
    side = F.when(F.col("seq") % 6 == 0, "train").when(F.col("seq") % 6 == 1, "eval")
    df = decision_rows(spark, sf_dir).select("id", "family", side.alias("side"))
    return merge.split_forced(df, "side", lambda free: merge.split_by_fraction(free, 0.1)).select("id", "is_eval")


@query(
    "rebalance",
    f"""WITH {ROWS}, c AS (SELECT family, count(*) AS n, count(*) FILTER (WHERE split = 'eval') AS e, count(*) FILTER (WHERE split = 'train') AS t FROM rows0 GROUP BY family),
d AS (SELECT family, greatest(0, CAST(round_even(n * 0.4::DOUBLE, 0) AS BIGINT) + 1 - e) AS deficit FROM c WHERE t > 0)
SELECT id, CASE WHEN split = 'train' AND row_number() OVER (PARTITION BY r.family, split ORDER BY sha256('7|' || r.family || '|' || id), id) <= coalesce(deficit, 0) THEN 'eval' ELSE split END AS split
FROM rows0 r LEFT JOIN d ON r.family = d.family""",
)
def rebalance(spark, sf_dir):
    return merge.rebalance(decision_rows(spark, sf_dir).select("id", "family", "split"), 0.4).select("id", "split")


HORNER = "list_reduce(list_prepend(0::BIGINT, list_transform(range(0, 8), lambda i: CAST('0x' || substr(sha256({k}), CAST(i * 8 + 1 AS BIGINT), 8) AS BIGINT))), lambda a, b: (a * 296 + b) % 1000)"


@query("content_split_tag", f"""WITH {ROWS}, k AS (SELECT id, 'salt' || concat_ws('::', {n2("family")}, {n2("context")}, {n2("question")}, array_to_string(list_transform(options, lambda x: {n2("x")}), chr(30))) AS key FROM rows0)
SELECT id, CASE WHEN {HORNER.format(k="key")} < 500 THEN 'eval-half' ELSE 'train-half' END AS half, {HORNER.format(k="key")} AS bucket FROM k""")
def content_split_tag(spark, sf_dir):
    key = content_key("family", "context", "question", F.col("options"))
    return decision_rows(spark, sf_dir).select("id", content_split(key, "salt", 0.5).alias("half"), sha_mod(F.concat(F.lit("salt"), key)).alias("bucket"))


@query("family_mix", f"WITH {ROWS} SELECT family, count(*) AS n, min(seq) AS first_seq FROM rows0 GROUP BY family")
def family_mix(spark, sf_dir):
    return audit.family_mix(decision_rows(spark, sf_dir))


@query("n_hist", f"WITH {ROWS} SELECT CAST(len(options) AS INT) AS n_options, count(*) AS n FROM rows0 GROUP BY 1")
def n_hist(spark, sf_dir):
    return audit.option_histogram(decision_rows(spark, sf_dir))


@query("n_hist_family", f"WITH {ROWS} SELECT family, count(*) FILTER (WHERE len(options) < 8) AS n_lt8, count(*) FILTER (WHERE len(options) = 4) AS n_4, count(*) FILTER (WHERE len(options) = 8) AS n_8, count(*) AS n FROM rows0 GROUP BY family")
def n_hist_family(spark, sf_dir):
    return audit.family_option_counts(decision_rows(spark, sf_dir))


@query("tier_counts", f"WITH {ROWS} SELECT CASE WHEN family IN ('src1','src2') THEN 'fact' ELSE 'shape' END AS tier, count(*) AS n, count(*) FILTER (WHERE fact_flagged) AS n_flagged FROM rows0 GROUP BY 1")
def tier_counts(spark, sf_dir):
    tier = F.when(F.col("family").isin("src1", "src2"), "fact").otherwise("shape")
    return decision_rows(spark, sf_dir).groupBy(tier.alias("tier")).agg(F.count("*").alias("n"), F.count_if("fact_flagged").alias("n_flagged"))


@query(
    "prob_checks",
    f"""WITH {PREDICTED}, g AS (SELECT CASE WHEN seq % 9 = 0 THEN list_transform(probs, lambda p: p * 1.1) ELSE probs END AS probs, correct_index, options FROM predicted)
SELECT CASE WHEN abs(list_sum(probs) - 1) > 0.01 THEN 'bad_sum' WHEN correct_index IS NULL THEN 'no_gold' WHEN probs[correct_index + 1] < 0.5 THEN 'gold_low' WHEN probs[correct_index + 1] < 0.9 THEN 'gold_soft' ELSE 'ok' END AS class, count(*) AS n FROM g GROUP BY 1""",
)
def prob_checks(spark, sf_dir):
    df = predicted_rows(spark, sf_dir).withColumn("probs", F.when(F.col("seq") % 9 == 0, F.transform("probs", lambda p: p * 1.1)).otherwise(F.col("probs")))
    return df.groupBy(audit.probability_class().alias("class")).agg(F.count("*").alias("n"))


@query("ctx_median", f"WITH {ROWS} SELECT family, median(CASE WHEN {n2('context')} = '' THEN 0 ELSE len(string_split({n2('context')}, ' ')) END) AS median_words FROM rows0 GROUP BY family")
def ctx_median(spark, sf_dir):
    return audit.context_median(decision_rows(spark, sf_dir))


@query(
    "top_bigrams",
    f"""WITH {ROWS}, w AS (SELECT regexp_extract_all(lower(context), '[a-z0-9'']+') AS w FROM rows0),
b AS (SELECT unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS bigram FROM w)
SELECT bigram, count(*) AS n FROM b GROUP BY bigram ORDER BY n DESC, bigram LIMIT 10""",
)
def top_bigrams(spark, sf_dir):
    return audit.top_bigrams(decision_rows(spark, sf_dir))


@query("eval_fraction", f"WITH {ROWS}, c AS (SELECT family, count(*) FILTER (WHERE split = 'train') AS n_train, count(*) FILTER (WHERE split = 'eval') AS n_eval FROM rows0 GROUP BY family) SELECT *, round(n_eval / CAST(n_train + n_eval AS DOUBLE), 9) AS eval_fraction, n_eval / CAST(n_train + n_eval AS DOUBLE) < 0.09 AS low FROM c")
def eval_fraction(spark, sf_dir):
    return audit.eval_fractions(decision_rows(spark, sf_dir)).withColumn("eval_fraction", F.round("eval_fraction", 9))


@query("topic_overlap", f"WITH {ROWS}, p AS (SELECT family, topic, bool_or(split = 'train') AS t, bool_or(split = 'eval') AS e FROM rows0 WHERE topic IS NOT NULL GROUP BY family, topic) SELECT family, count(*) FILTER (WHERE t) AS train_topics, count(*) FILTER (WHERE e) AS eval_topics, count(*) FILTER (WHERE t AND e) AS shared_topics FROM p GROUP BY family")
def topic_overlap(spark, sf_dir):
    return audit.topic_overlap(decision_rows(spark, sf_dir))


@query("census_rollup", f"WITH {ROWS} SELECT family, topic, count(*) AS n, CAST(grouping_id(family, topic) AS BIGINT) AS level FROM rows0 GROUP BY ROLLUP (family, topic)")
def census_rollup(spark, sf_dir):
    return audit.census(decision_rows(spark, sf_dir))


BUCKET = "CASE WHEN family IN ('src0','src1','src2','src3','src4') THEN 'first' WHEN family IN ('src5','src6') THEN 'second' ELSE 'rest' END"


@query(
    "census_share",
    f"""WITH {ROWS}, o AS (SELECT {BUCKET} AS bucket, family, count(*) AS n FROM rows0 GROUP BY 1, 2),
g AS (SELECT family, bucket, sum(n) AS n, grouping_id(family, bucket) AS level FROM o GROUP BY GROUPING SETS ((family), (bucket), ()))
SELECT family, bucket, CAST(n AS BIGINT) AS n, CAST(level AS BIGINT) AS level, round(100.0::DOUBLE * n / (SELECT sum(n) FROM o), 6) AS percent FROM g""",
)
def census_share(spark, sf_dir):
    bucket = F.when(F.col("family").isin("src0", "src1", "src2", "src3", "src4"), "first").when(F.col("family").isin("src5", "src6"), "second").otherwise("rest")
    return audit.shares(decision_rows(spark, sf_dir).withColumn("bucket", bucket), "family", "bucket")


@query("first_example", f"WITH {ROWS} SELECT family, topic, min_by(id, seq) AS example FROM rows0 GROUP BY family, topic")
def first_example(spark, sf_dir):
    return audit.first_examples(decision_rows(spark, sf_dir), "family", "topic")


CHECKS = f"""WITH {KEYED}, p AS (SELECT *, CASE WHEN family IN ('src1','src2') THEN 'fact' ELSE 'shape' END AS tier, seq % 3 > 0 AS sourced FROM keyed),
pp AS (SELECT p.*, q.probs FROM p JOIN (WITH {PREDICTED} SELECT id, probs FROM predicted) q USING (id)),
e AS (SELECT family, count(*) FILTER (WHERE split = 'eval') / CAST(count(*) AS DOUBLE) < 0.09 AS low FROM p GROUP BY family),
d AS (SELECT key, bool_or(split = 'train') AND bool_or(split = 'eval') AS x FROM p GROUP BY key)
SELECT 'fewer_than_8_options' AS "check", count(*) FILTER (WHERE len(options) < 8) AS value, true AS passed FROM pp
UNION ALL SELECT 'bad_probabilities', count(*) FILTER (WHERE abs(list_sum(probs) - 1) > 0.01), count(*) FILTER (WHERE abs(list_sum(probs) - 1) > 0.01) = 0 FROM pp
UNION ALL SELECT 'gold_below_half', count(*) FILTER (WHERE probs[correct_index + 1] < 0.5), count(*) FILTER (WHERE probs[correct_index + 1] < 0.5) = 0 FROM pp
UNION ALL SELECT 'padding_as_gold', 0, true
UNION ALL SELECT 'missing_tier', 0, true
UNION ALL SELECT 'facts_without_source', count(*) FILTER (WHERE tier = 'fact' AND NOT sourced), count(*) FILTER (WHERE tier = 'fact' AND NOT sourced) = 0 FROM pp
UNION ALL SELECT 'families_short_of_eval', count(*) FILTER (WHERE low), count(*) FILTER (WHERE low) = 0 FROM e
UNION ALL SELECT 'keys_across_splits', count(*) FILTER (WHERE x), count(*) FILTER (WHERE x) = 0 FROM d"""


@query("gate_checks", CHECKS)
def gate_checks(spark, sf_dir):
    df = predicted_rows(spark, sf_dir).withColumn("key", keys.row_key()).withColumn("tier", F.when(F.col("family").isin("src1", "src2"), "fact").otherwise("shape")).withColumn("sourced", F.col("seq") % 3 > 0)
    return audit.gate(df)


@query("union_splits", f"WITH {ROWS} SELECT split, count(*) AS n FROM rows0 GROUP BY split")
def union_splits(spark, sf_dir):
    df = decision_rows(spark, sf_dir)
    return df.filter("split = 'train'").unionByName(df.filter("split = 'eval'")).groupBy("split").agg(F.count("*").alias("n"))


@query("topic_intersect", f"WITH {ROWS} SELECT family, topic FROM rows0 WHERE split = 'train' AND topic IS NOT NULL INTERSECT SELECT family, topic FROM rows0 WHERE split = 'eval' AND topic IS NOT NULL")
def topic_intersect(spark, sf_dir):
    df = decision_rows(spark, sf_dir).filter("topic is not null")
    return df.filter("split = 'train'").select("family", "topic").intersect(df.filter("split = 'eval'").select("family", "topic"))


@query("key_union", f"{GUARDED} SELECT count(*) AS n FROM (SELECT key FROM q WHERE split = 'train' UNION SELECT key FROM q WHERE split = 'eval')")
def key_union(spark, sf_dir):
    q = keyed_rows(spark, sf_dir)
    return q.filter("split = 'train'").select("key").union(q.filter("split = 'eval'").select("key")).distinct().agg(F.count("*").alias("n"))


@query("seeded_sample", f"WITH {ROWS} SELECT id FROM rows0 ORDER BY sha256('7|' || id), id LIMIT 100")
def seeded_sample(spark, sf_dir):
    """A sampling operator: a uniform sample of 100 rows."""
    from decisium.operators.mining import seeded_sample as sample

    return sample(decision_rows(spark, sf_dir), 100, 7, "id").select("id")
