"""Queries over texts, encodings and predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from decisium.functions import arrays as A
from decisium.functions import hashing as H
from decisium.functions import text as T
from decisium.functions import wiki
from decisium.operators import encode, metrics
from decisium.plans.base import PREDICTED, ROWS, decision_rows, n1, n2, predicted_rows, query
from decisium.runtime import table

TOKEN = r"[\p{L}\p{N}]+(?:''[\p{L}\p{N}]+)?|[^\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


@query("tokens", f"SELECT doc_id, len(t) AS n, sha256(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, regexp_extract_all({n1('text')}, '{TOKEN}') AS t FROM documents)")
def tokens(spark, sf_dir):
    df = docs(spark, sf_dir).select("doc_id", T.tokens(T.model_text("text")).alias("t"))
    return df.select("doc_id", F.size("t").cast("long").alias("n"), F.sha2(F.array_join("t", " "), 256).alias("digest"))


@query("word_count", f"SELECT doc_id, CASE WHEN {n2('text')} = '' THEN 0 ELSE CAST(len(string_split({n2('text')}, ' ')) AS INT) END AS n FROM documents")
def word_count(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.word_count("text").alias("n"))


@query("ascii_words", "SELECT doc_id, CAST(len(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9'']+')) AS INT) AS n FROM documents")
def ascii_words(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.size(T.ascii_words("text")).alias("n"))


@query(
    "sentences",
    rf"""WITH s AS (SELECT doc_id, list_filter(string_split(regexp_replace({n2('text')}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS s FROM documents)
SELECT doc_id, CAST(len(s) AS INT) AS n, sha256(array_to_string(s, chr(10))) AS digest FROM s""",
)
def sentences(spark, sf_dir):
    df = docs(spark, sf_dir).select("doc_id", T.sentences("text").alias("s"))
    return df.select("doc_id", F.size("s").alias("n"), F.sha2(F.array_join("s", "\n"), 256).alias("digest"))


VOCAB = f"""vocab AS (SELECT word, n, row_number() OVER (ORDER BY n DESC, word) - 1 + 4098 AS id FROM (
  SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all({n1('text')}, '{TOKEN}')) AS word FROM documents) GROUP BY word ORDER BY n DESC, word LIMIT 2000))"""


@query("vocab_topk", f"WITH {VOCAB} SELECT word, n, id FROM vocab")
def vocab_topk(spark, sf_dir):
    return encode.vocabulary(docs(spark, sf_dir), [F.col("text")], 2000)


@query(
    "encode_ids",
    f"""WITH {VOCAB}, w AS (SELECT doc_id, unnest(t) AS word, generate_subscripts(t, 1) AS pos FROM (SELECT doc_id, regexp_extract_all({n1('text')}, '{TOKEN}') AS t FROM documents)),
e AS (SELECT doc_id, pos, coalesce(id, CASE WHEN regexp_full_match(w.word, '[0-9]+') THEN CAST(w.word::HUGEINT % 4096 AS BIGINT) + 2 END, 1) AS id FROM w LEFT JOIN vocab v ON w.word = v.word)
SELECT d.doc_id, count(e.id) AS n, coalesce(sha256(string_agg(CAST(id AS VARCHAR), ',' ORDER BY pos)), sha256('')) AS digest FROM documents d LEFT JOIN e ON d.doc_id = e.doc_id GROUP BY d.doc_id""",
)
def encode_ids(spark, sf_dir):
    d = docs(spark, sf_dir)
    ids = encode.encode(d, "doc_id", "text", encode.vocabulary(d, [F.col("text")], 2000))
    return ids.select("doc_id", F.size("ids").cast("long").alias("n"), F.sha2(F.array_join(F.transform("ids", lambda i: i.cast("string")), ","), 256).alias("digest"))


@query(
    "pad_mask",
    """WITH c AS (SELECT conv_id, turn, list_transform(range(0, CAST(least(len(coalesce(text, '')), 40) AS BIGINT)), lambda i: i) AS a FROM conversations)
SELECT conv_id, turn, array_to_string(list_concat(a[1:32], list_transform(range(0, 32 - least(len(a), 32)), lambda i: 0)), ',') AS ids,
  array_to_string(list_transform(range(0, 32), lambda i: CASE WHEN i < len(a) THEN '1' ELSE '0' END), '') AS mask FROM c""",
)
def pad_mask(spark, sf_dir):
    n = F.least(F.length(F.coalesce("text", F.lit(""))), F.lit(40))
    a = F.when(n == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))))
    df = table(spark, sf_dir, "conversations").select("conv_id", "turn", a.alias("a"))
    ids = F.array_join(F.transform(A.padded("a", 32), lambda x: x.cast("string")), ",")
    mask = F.array_join(F.transform(A.valid_mask("a", 32), lambda m: F.when(m, "1").otherwise("0")), "")
    return df.select("conv_id", "turn", ids.alias("ids"), mask.alias("mask"))


_MULT = {k: v for k, v in H.ngram_multipliers((2, 3), 2, 1 << 18, 11).items()}


def _ngram_sql() -> str:
    parts = []
    for (o, h), m in _MULT.items():
        terms = " + ".join(f"(b[i + {j + 1}] + 1) * {x}::BIGINT" for j, x in enumerate(m))
        parts.append(f"SELECT item_id, {o} AS ngram_order, {h} AS head, CAST(len(b) - {o} + 1 AS BIGINT) AS n, CAST(list_sum(list_transform(range(0, len(b) - {o} + 1), lambda i: ({terms}) % 262144)) AS BIGINT) AS total FROM bytes")
    return "WITH bytes AS (SELECT item_id, list_transform(range(1, octet_length(encode(text)) + 1), lambda i: CAST('0x' || substr(hex(encode(text)), CAST(2 * i - 1 AS BIGINT), 2) AS BIGINT)) AS b FROM benchmark)\n" + "\nUNION ALL ".join(parts)


@query("ngram_hash", _ngram_sql())
def ngram_hash(spark, sf_dir):
    df = table(spark, sf_dir, "benchmark").select("item_id", H.byte_values(F.col("text")).alias("b"))
    cols = [F.struct(F.lit(o).alias("ngram_order"), F.lit(h).alias("head"), H.ngram_hashes(F.col("b"), m, 1 << 18).alias("v")) for (o, h), m in _MULT.items()]
    df = df.select("item_id", F.explode(F.array(*cols)).alias("x")).select("item_id", "x.*")
    return df.select("item_id", "ngram_order", "head", F.size("v").cast("long").alias("n"), F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


REPLIES = ["3", "9) x", "(B) because", "h", "", "Z", "  2.", "answer: c", "10", "0", "-1 b", "99999999999999999999"]


_REPLIES = "[" + ", ".join("'" + r.replace("'", "''") + "'" for r in REPLIES) + "]"


@query(
    "parse_choice",
    f"""WITH {ROWS}, r AS (SELECT id, {_REPLIES}[seq % {len(REPLIES)} + 1] AS reply, len(options) AS n FROM rows0),
c AS (SELECT *, regexp_extract(trim(reply), '^([0-9]+)', 1) AS d, upper(regexp_extract(trim(reply), '([A-Ha-h])', 1)) AS l FROM r),
k AS (SELECT *, CASE WHEN d <> '' THEN CAST(d AS HUGEINT) WHEN l <> '' THEN ascii(l) - 65 END AS k FROM c)
SELECT id, reply, CAST(CASE WHEN k >= 0 AND k < n THEN k END AS INT) AS choice FROM k""",
)
def parse_choice(spark, sf_dir):
    replies = F.array(*[F.lit(r) for r in REPLIES])
    df = decision_rows(spark, sf_dir).select("id", F.get(replies, F.pmod("seq", F.lit(len(REPLIES))).cast("int")).alias("reply"), F.size("options").alias("n"))
    return df.select("id", "reply", T.parsed_choice("reply", F.col("n")).alias("choice"))


@query("json_array", r"""WITH r AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'Here: [' || doc_id || ', 2] done' WHEN 1 THEN 'none' ELSE 'a ] b' END AS reply FROM documents)
SELECT doc_id, nullif(regexp_extract(reply, '(?s)\[.*\]'), '') AS found FROM r""")
def json_array(spark, sf_dir):
    k = F.col("doc_id") % 3
    reply = F.when(k == 0, F.concat(F.lit("Here: ["), F.col("doc_id").cast("string"), F.lit(", 2] done"))).when(k == 1, "none").otherwise("a ] b")
    return docs(spark, sf_dir).select("doc_id", T.json_array_text(reply).alias("found"))


@query("hour_label", "SELECT event_id, CASE WHEN hour(ts) % 12 = 0 THEN '12' ELSE CAST(hour(ts) % 12 AS VARCHAR) END || CASE WHEN hour(ts) < 12 THEN ' am' ELSE ' pm' END AS label FROM events")
def hour_label(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", T.hour_label(F.hour("ts")).alias("label"))


@query("similarity_ratio")
def similarity_ratio(spark, sf_dir):
    """Each turn against the one before it in its conversation; the first against the empty text."""
    from pyspark.sql import Window

    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    df = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", before.alias("before"))
    return df.select("conv_id", "turn", F.round(T.similarity("before", "text"), 9).alias("ratio"))


@query("has_number", r"SELECT doc_id, list_contains(regexp_extract_all(coalesce(text, ''), '\d+'), CAST(doc_id % 10 AS VARCHAR)) AS found FROM documents")
def has_number(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.has_number("text", F.col("doc_id") % 10).alias("found"))


@query("number_bucket", "SELECT o_orderkey, CAST((CAST('9' || o_orderkey || '00000000001' AS HUGEINT)) % 4096 AS BIGINT) + 2 AS id FROM orders")
def number_bucket(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", H.number_bucket(F.concat(F.lit("9"), F.col("o_orderkey").cast("string"), F.lit("00000000001"))).alias("id"))


@query("softmax", "WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: exp(x::DOUBLE - list_max(embedding)::DOUBLE)) AS e FROM embeddings) SELECT vec_id, round(list_max(e) / list_sum(e), 9) AS top FROM v")
def softmax(spark, sf_dir):
    df = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("x"))
    return df.select("vec_id", F.round(F.array_max(A.softmax("x")), 9).alias("top"))


GOLD = "probs[correct_index + 1]"
RIGHT = "CASE WHEN list_position(probs, list_max(probs)) - 1 = correct_index THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"
ONE = "list_sum(list_transform(range(0, len(probs)), lambda i: (probs[i + 1] - CASE WHEN i = correct_index THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) ** 2))"
AGGS = f"count(*) AS n, round(avg({RIGHT}), 9) AS accuracy, round(avg(-ln(greatest({GOLD}, 1e-9))), 9) AS log_loss, round(avg({ONE}), 9) AS brier"


def _rounded(df, *names):
    return df.withColumns({n: F.round(n, 9) for n in names})


@query("accuracy", f"WITH {PREDICTED} SELECT {AGGS} FROM predicted WHERE correct_index IS NOT NULL")
def accuracy(spark, sf_dir):
    return _rounded(metrics.scores(predicted_rows(spark, sf_dir)), "accuracy", "log_loss", "brier")


@query("accuracy_family", f"WITH {PREDICTED} SELECT family, {AGGS} FROM predicted WHERE correct_index IS NOT NULL GROUP BY family")
def accuracy_family(spark, sf_dir):
    return _rounded(metrics.scores(predicted_rows(spark, sf_dir).filter("correct_index is not null"), "family"), "accuracy", "log_loss", "brier")


@query("accuracy_n", f"WITH {PREDICTED} SELECT CAST(len(options) AS INT) AS n_options, {AGGS} FROM predicted WHERE correct_index IS NOT NULL GROUP BY 1")
def accuracy_n(spark, sf_dir):
    df = predicted_rows(spark, sf_dir).filter("correct_index is not null").withColumn("n_options", F.size("options"))
    return _rounded(metrics.scores(df, "n_options"), "accuracy", "log_loss", "brier")


@query("brier_teacher", f"WITH {PREDICTED} SELECT round(avg(list_sum(list_transform(range(0, len(probs)), lambda i: (probs[i + 1] - teacher[i + 1]) ** 2))), 9) AS brier FROM predicted")
def brier_teacher(spark, sf_dir):
    return predicted_rows(spark, sf_dir).agg(F.round(F.avg(A.squared_distance("probs", "teacher")), 9).alias("brier"))


@query("masked_kl", f"WITH {PREDICTED} SELECT round(avg(list_sum(list_transform(range(0, len(probs)), lambda i: CASE WHEN teacher[i + 1] > 0 THEN teacher[i + 1] * (ln(teacher[i + 1]) - ln(greatest(probs[i + 1], 1e-9))) ELSE 0 END))), 9) AS kl FROM predicted")
def masked_kl(spark, sf_dir):
    return predicted_rows(spark, sf_dir).agg(F.round(F.avg(A.masked_kl("teacher", "probs")), 9).alias("kl"))


CONF = f"""WITH {PREDICTED}, c AS (SELECT list_max(probs) AS c, {RIGHT} AS ok FROM predicted WHERE correct_index IS NOT NULL)"""


@query("calibration_bins", f"{CONF} SELECT CAST(least(floor(c * 10), 9) AS INT) AS bin, count(*) AS n, round(avg(c), 9) AS confidence, round(avg(ok), 9) AS accuracy FROM c GROUP BY 1")
def calibration_bins(spark, sf_dir):
    return _rounded(metrics.calibration(predicted_rows(spark, sf_dir)), "confidence", "accuracy")


@query("ece_fixed", f"{CONF}, b AS (SELECT count(*) AS n, avg(c) AS conf, avg(ok) AS acc FROM c GROUP BY least(floor(c * 10), 9)) SELECT round(sum(n * abs(acc - conf)) / sum(n), 9) AS ece FROM b")
def ece_fixed(spark, sf_dir):
    return _rounded(metrics.ece(predicted_rows(spark, sf_dir)), "ece")


@query("ece_minmax", f"{CONF}, e AS (SELECT min(c) AS lo, max(c) AS hi, count(*) AS n_all FROM c), b AS (SELECT count(*) AS n, avg(c) AS conf, avg(ok) AS acc FROM c, e WHERE floor((c - lo) / nullif(hi - lo, 0) * 10) < 10 GROUP BY floor((c - lo) / nullif(hi - lo, 0) * 10)) SELECT round(coalesce(sum(n / CAST((SELECT n_all FROM e) AS DOUBLE) * abs(acc - conf)), 0), 9) AS ece FROM b")
def ece_minmax(spark, sf_dir):
    return _rounded(metrics.ece_between(predicted_rows(spark, sf_dir)), "ece")


@query("perm_invariance", f"WITH {PREDICTED} SELECT round(max(list_max(list_transform(range(0, len(probs)), lambda i: abs(probs[i + 1] - teacher[i + 1])))), 9) AS max_error FROM predicted")
def perm_invariance(spark, sf_dir):
    return _rounded(metrics.invariance_error(predicted_rows(spark, sf_dir), "probs", "teacher"), "max_error")


@query(
    "rank_options",
    f"""WITH {PREDICTED}, o AS (SELECT id, unnest(options) AS option, unnest(probs) AS p, generate_subscripts(options, 1) - 1 AS place FROM predicted)
SELECT id, CAST(place AS INT) AS place, chr(CAST(65 + place AS INT)) AS letter, option, round(p, 9) AS p, CAST(row_number() OVER (PARTITION BY id ORDER BY p DESC, place) AS INT) AS rank, row_number() OVER (PARTITION BY id ORDER BY p DESC, place) = 1 AS is_top FROM o""",
)
def rank_options(spark, sf_dir):
    return _rounded(metrics.ranked_options(predicted_rows(spark, sf_dir), "id"), "p")


@query(
    "span_topk",
    """WITH s AS (SELECT vec_id, unnest(embedding)::DOUBLE AS score, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings),
g AS (SELECT vec_id, CAST(floor(pos / 8) AS INT) AS span, avg(score) AS mean_score FROM s GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(mean_score, 9) DESC, span) AS rank FROM g)
SELECT vec_id, span, round(mean_score, 6) AS mean_score, CAST(rank AS INT) AS rank FROM r WHERE rank <= 3""",
)
def span_topk(spark, sf_dir):
    df = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("scores"))
    return metrics.top_spans(df, "vec_id", "scores", 8, 3).withColumn("mean_score", F.round("mean_score", 6))


@query("confidence_bar", f"WITH {PREDICTED} SELECT id, repeat('#', CAST(round_even(list_max(probs) * 30, 0) AS INT)) AS bar FROM predicted")
def confidence_bar(spark, sf_dir):
    return predicted_rows(spark, sf_dir).select("id", T.bar(F.array_max("probs")).alias("bar"))


@query(
    "early_stop",
    """WITH e AS (SELECT CAST(date_diff('hour', (SELECT min(date_trunc('hour', ts)) FROM events), date_trunc('hour', ts)) AS BIGINT) AS epoch, round(avg(value), 6) AS loss FROM events GROUP BY 1),
b AS (SELECT *, CASE WHEN loss < coalesce(min(loss) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1e308) THEN 1 ELSE 0 END AS better FROM e),
i AS (SELECT *, sum(better) OVER (ORDER BY epoch) AS island FROM b),
s AS (SELECT epoch, loss, CAST(row_number() OVER (PARTITION BY island ORDER BY epoch) - 1 AS INT) AS stale FROM i)
SELECT epoch, loss, stale, max(stale) OVER (ORDER BY epoch) >= 3 AS stopped FROM s""",
)
def early_stop(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    hour = F.date_trunc("hour", "ts")
    first = ev.agg(F.min(hour).alias("first_hour"))
    per = ev.join(F.broadcast(first), F.lit(True)).groupBy(((F.unix_timestamp(hour) - F.unix_timestamp("first_hour")) / 3600).cast("long").alias("epoch")).agg(F.round(F.avg("value"), 6).alias("loss"))
    return metrics.early_stop(per).select("epoch", "loss", "stale", "stopped")


BAG = """WITH i AS (SELECT doc_id, unnest([doc_id, doc_id * 7 % 97]) AS id FROM documents), v AS (SELECT vec_id, CAST(generate_subscripts(embedding, 1) - 1 AS INT) AS dim, unnest(embedding)::DOUBLE AS value FROM embeddings)
SELECT doc_id, dim, round(sum(value), 6) AS value FROM i JOIN v ON id = vec_id GROUP BY doc_id, dim"""


@query("embedding_bag", BAG)
def embedding_bag(spark, sf_dir):
    """Sums of the embeddings that a document's number picks."""
    table_ = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("vector"))
    ids = docs(spark, sf_dir).select("doc_id", F.array(F.col("doc_id"), F.pmod(F.col("doc_id") * 7, F.lit(97))).alias("ids"))
    return encode.embedding_bag(ids, "doc_id", table_).withColumn("value", F.round("value", 6))


@query("masked_mean", "SELECT vec_id, round(list_avg(list_transform(list_filter(range(0, 64), lambda i: i % 3 > 0), lambda i: embedding[i + 1]::DOUBLE)), 6) AS mean FROM embeddings")
def masked_mean(spark, sf_dir):
    x = F.transform("embedding", lambda v: v.cast("double"))
    mask = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: i % 3 > 0)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(A.masked_mean(x, mask), 6).alias("mean"))


@query("array_shuffle", f"""WITH {ROWS} SELECT id, array_to_string(list_transform(list_sort(list_transform(range(0, len(options)), lambda i: sha256('7|' || id || '|' || i) || '/' || options[i + 1])), lambda x: string_split(x, '/')[2]), ',') AS shuffled FROM rows0""")
def array_shuffle(spark, sf_dir):
    return decision_rows(spark, sf_dir).select("id", F.array_join(A.shuffled("options", 7, "id"), ",").alias("shuffled"))


@query("array_sets", "SELECT vec_id, list_sum(list_intersect(range(0, 20), range(CAST(vec_id % 30 AS BIGINT), CAST(vec_id % 30 + 10 AS BIGINT)))) AS both FROM embeddings")
def array_sets(spark, sf_dir):
    r = F.col("vec_id") % 30
    both = F.array_intersect(F.transform(F.sequence(F.lit(0), F.lit(19)), lambda i: i.cast("long")), F.sequence(r, r + 9))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.when(F.size(both) > 0, F.aggregate(both, F.lit(0).cast("long"), lambda a, x: a + x)).alias("both"))


PLAIN = r"""WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(regexp_replace(coalesce(text, ''), '(?m)^#+ .*$', '', 'g'), '\n+', ' ', 'g'), '. '), lambda x: trim(x)), lambda x: x <> '') AS s FROM documents)
SELECT doc_id, CAST(len(s) AS INT) AS n, sha256(array_to_string(s, chr(10))) AS digest FROM s"""


@query("plain_sentences", PLAIN)
def plain_sentences(spark, sf_dir):
    df = docs(spark, sf_dir).select("doc_id", wiki.plain_sentences("text").alias("s"))
    return df.select("doc_id", F.size("s").alias("n"), F.sha2(F.array_join("s", "\n"), 256).alias("digest"))


@query("clean_sentence", "SELECT o_orderkey, 'The order of ' || o_orderpriority || 'holds item .' AS clean FROM orders")
def clean_sentence(spark, sf_dir):
    dot, o = chr(0xB7), table(spark, sf_dir, "orders")
    s = F.concat(F.lit(dot + " The order ''of'' "), F.col("o_orderpriority"), F.lit(" ["), F.col("o_orderkey").cast("string"), F.lit("] holds item(s) .The"))
    return o.select("o_orderkey", wiki.clean_sentence(s).alias("clean"))
