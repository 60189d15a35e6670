"""The registry, and the fixture relations that several queries share, in Spark and in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from decisium.operators import keys
from decisium.runtime import table

FOUND: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(name: str, sql: str | None = None):
    """Register a query under ``name`` with its SQL, if it has one."""

    def add(f):
        FOUND[name] = (f, sql)
        return f

    return add


WS = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def n2(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '{WS}+', ' ', 'g'))"


def n1(x: str) -> str:
    return f"lower({n2(x)})"


def joined(fn, options: str = "options") -> str:
    return f"array_to_string(list_transform({options}, lambda x: {fn('x')}), chr(31))"


LANGUAGES = ["en", "fr", "de", "es", "it", "nl", "pt", "sv"]
QUESTION = "Which language is this passage written in?"


def decision_rows(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None) -> DataFrame:
    """Decision rows from all documents, or from ``docs``: family is the source, topic the language, the context the whole text."""
    docs, labels = table(spark, sf_dir, "documents") if docs is None else docs, table(spark, sf_dir, "labels")
    df = docs.join(labels.withColumnRenamed("doc_id", "label_id"), F.col("doc_id") == F.col("label_id"), "left")
    n = (F.lit(4) + F.col("doc_id") % 5).cast("int")
    gold = F.nullif(F.array_position(F.array(*[F.lit(x) for x in LANGUAGES[:4]]), F.col("lang")), F.lit(0))
    return df.select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("id"),
        F.col("source").alias("family"),
        F.col("lang").alias("topic"),
        F.col("doc_id").alias("seq"),
        F.when(F.col("doc_id") % 4 == 0, "eval").otherwise("train").alias("split"),
        F.col("text").alias("context"),
        F.lit(QUESTION).alias("question"),
        F.slice(F.array(*[F.lit(x) for x in LANGUAGES]), F.lit(1), n).alias("options"),
        F.when(F.col("quality") == 0, None).otherwise((gold - 1).cast("int")).alias("correct_index"),
        (F.coalesce("toxic", F.lit(0)) == 1).alias("fact_flagged"),
    )


ROWS = f"""rows0 AS (
  SELECT 'doc-' || d.doc_id AS id, d.source AS family, d.lang AS topic, d.doc_id AS seq,
    CASE WHEN d.doc_id % 4 = 0 THEN 'eval' ELSE 'train' END AS split, d.text AS context, '{QUESTION}' AS question,
    ['en','fr','de','es','it','nl','pt','sv'][1:CAST(4 + d.doc_id % 5 AS INT)] AS options,
    CASE WHEN l.quality = 0 THEN NULL ELSE CAST(list_position(['en','fr','de','es'], d.lang) - 1 AS INT) END AS correct_index,
    coalesce(l.toxic, 0) = 1 AS fact_flagged
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def keyed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decision_rows(spark, sf_dir).withColumn("key", keys.row_key())


KEYED = f"""{ROWS},
keyed AS (SELECT *, sha256(concat_ws(chr(30), {n1("context")}, {n1("question")}, {joined(n1)})) AS key FROM rows0)"""


def predicted_rows(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None) -> DataFrame:
    """Decision rows with probabilities derived from hashes (they stand for a model's)."""
    df = decision_rows(spark, sf_dir, docs)

    def weight(i, salt=""):
        return F.conv(F.substring(F.sha2(F.concat(F.col("seq").cast("string"), F.lit("|" + salt), i.cast("string")), 256), 1, 6), 16, 10).cast("double") + 1

    def probs(salt=""):
        w = F.transform(F.sequence(F.lit(0), F.size("options") - 1), lambda i: weight(i, salt))
        total = F.aggregate(w, F.lit(0.0), lambda a, x: a + x)
        return F.transform(w, lambda x: x / total)

    return df.withColumn("probs", probs()).withColumn("teacher", probs("t"))


def _probs_sql(salt: str) -> str:
    w = f"list_transform(range(0, len(options)), lambda i: CAST(CAST('0x' || substr(sha256(seq || '|{salt}' || i), 1, 6) AS BIGINT) AS DOUBLE) + 1)"
    return f"list_transform({w}, lambda x: x / list_sum({w}))"


PREDICTED = f"""{ROWS},
predicted AS (SELECT *, {_probs_sql("")} AS probs, {_probs_sql("t")} AS teacher FROM rows0)"""


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encyclopedia pages made of all nations."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    df = nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))
    n, r = F.col("n_name"), F.col("r_name")
    nl = F.lit("\n")
    number = lambda c: c.cast("string")
    text = F.concat(
        F.lit("{{Short description|Country in "), r, F.lit("}}"), nl, F.lit("{{Infobox country"), nl,
        F.lit("| capital = [[Port "), n, F.lit("|Port "), n, F.lit("]]"), nl, F.lit("| currency = "), n, F.lit(" crown"), nl,
        F.lit("| area_total_km2 = "), number(1000 + F.col("n_nationkey") * 37), nl, F.lit("}}"), nl,
        n, F.lit(" is a country located in "), r, F.lit(" and it was founded in "), number(1500 + F.col("n_nationkey") * 17), F.lit(". "),
        F.lit("It borders [[Sea of "), r, F.lit("|the "), r, F.lit(" sea]].<ref>x</ref> It was ruled by a council of elders."), nl,
        F.lit("== History =="), nl, F.lit("Its records were established by Ada "), n,
        F.lit(" in the old port. [[Category:Countries in "), r, F.lit("]] [[Category:All stub articles]] [[Category:Ports of "), n, F.lit("|Port]]"),
    )
    return df.select(n.alias("title"), F.col("n_nationkey").alias("seq"), F.when(F.col("n_nationkey") % 9 == 8, "REGION").alias("redirect_target"), text.alias("text"))


PAGES = """wiki AS (
  SELECT n_name AS title, n_nationkey AS seq, CASE WHEN n_nationkey % 9 = 8 THEN 'REGION' ELSE NULL END AS redirect_target,
    concat('{{Short description|Country in ', r_name, '}}', chr(10), '{{Infobox country', chr(10),
      '| capital = [[Port ', n_name, '|Port ', n_name, ']]', chr(10), '| currency = ', n_name, ' crown', chr(10),
      '| area_total_km2 = ', CAST(1000 + n_nationkey * 37 AS VARCHAR), chr(10), '}}', chr(10),
      n_name, ' is a country located in ', r_name, ' and it was founded in ', CAST(1500 + n_nationkey * 17 AS VARCHAR), '. ',
      'It borders [[Sea of ', r_name, '|the ', r_name, ' sea]].<ref>x</ref> It was ruled by a council of elders.', chr(10),
      '== History ==', chr(10), 'Its records were established by Ada ', n_name,
      ' in the old port. [[Category:Countries in ', r_name, ']] [[Category:All stub articles]] [[Category:Ports of ', n_name, '|Port]]') AS text,
    r_name AS region, CAST(1500 + n_nationkey * 17 AS VARCHAR) AS founded
  FROM nation JOIN region ON n_regionkey = r_regionkey)"""
