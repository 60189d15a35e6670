"""The registered queries of this subpackage: ``op<N>_<name>`` and ``pipeline``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from decisium.llm import chat, flac, html_wrappers, mixing, near_dup, packing, quality, secret_scan, token_files, warc
from decisium.runtime import table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written to flat token files, and every document's place and token count found by scanning them."""
    files = token_files.write_token_files(table(spark, sf_dir, "documents").select("text"))
    return token_files.token_counts(files)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts, score and verdict of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = quality.judge(docs, table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("score", 9).alias("score"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    found = html_wrappers.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


def op5_sainte_lague_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words the mix takes of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts, the digest of the base spans, and all spans of every document."""
    found = secret_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = {r.kind: i for i, r in enumerate(secret_scan.BASE_RULES)}

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")

    def count(rule):
        return F.size(F.filter("spans", lambda s: s["rule"] == rule)).cast("long")

    own = F.filter("spans", lambda s: s["rule"] < len(base))
    counts = [count(i).alias(f"n_{k}") for k, i in base.items()]
    return found.select("doc_id", *counts, F.sha2(listed(own).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def op7_preference_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation against itself with a shortened last answer, as prompt and masked completions."""
    pairs = chat.shortened_pairs(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))

    def listed(spans: str):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["start"].cast("string"), s["stop"].cast("string"))), ",")

    return pairs.withColumn("chosen_spans", listed("chosen_spans")).withColumn("rejected_spans", listed("rejected_spans"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives and read back."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    manifest = warc.write_archives(warc.plan_revisits(pages))
    return warc.resolved(warc.read_archives(manifest))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate component of every document (3-word shingles, similarity of 0.85 or more)."""
    return near_dup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), 3, 85, 100)


def op10_flac_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as a FLAC stream and read back."""
    return flac.digests(flac.encode_column(table(spark, sf_dir, "documents")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    found = {name: f for name, f in globals().items() if name.startswith("op") and name[2:3].isdigit()}
    return found | {"pipeline": corpus_pipeline.run}


OP7_SQL = r"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i
  FROM conversations
), l AS (
  SELECT conv_id, max(CASE WHEN role = 'assistant' THEN i END) AS la, count(*) AS n FROM t GROUP BY conv_id
), u AS (
  SELECT t.conv_id, t.role, t.text, t.i,
         CASE WHEN t.i = l.la THEN left(t.text, CAST(length(t.text) // 2 AS BIGINT)) ELSE t.text END AS cut
  FROM t JOIN l USING (conv_id)
), d AS (
  SELECT conv_id, coalesce(min(CASE WHEN text <> cut THEN i END), max(i) + 1) AS first_new FROM u GROUP BY conv_id
), r AS (
  SELECT u.conv_id, u.i, u.role, d.first_new,
         '<|im_start|>' || replace(u.role, '<|', '<\|') || chr(10) AS head,
         replace(u.text, '<|', '<\|') || '<|im_end|>' || chr(10) AS a,
         replace(u.cut, '<|', '<\|') || '<|im_end|>' || chr(10) AS b
  FROM u JOIN d USING (conv_id)
), s AS (
  SELECT *, sum(CASE WHEN i >= first_new THEN length(head) + length(a) ELSE 0 END) OVER w AS a_stop,
            sum(CASE WHEN i >= first_new THEN length(head) + length(b) ELSE 0 END) OVER w AS b_stop
  FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY i)
)
SELECT conv_id, CAST(any_value(first_new) - 1 AS INTEGER) AS n_prompt_turns,
  coalesce(string_agg(head || a, '' ORDER BY i) FILTER (WHERE i < first_new), '') AS prompt,
  coalesce(string_agg(head || a, '' ORDER BY i) FILTER (WHERE i >= first_new), '') AS chosen,
  coalesce(string_agg(CAST(a_stop - length(a) AS VARCHAR) || ':' || CAST(a_stop AS VARCHAR), ',' ORDER BY i) FILTER (WHERE i >= first_new AND role = 'assistant'), '') AS chosen_spans,
  coalesce(string_agg(head || b, '' ORDER BY i) FILTER (WHERE i >= first_new), '') AS rejected,
  coalesce(string_agg(CAST(b_stop - length(b) AS VARCHAR) || ':' || CAST(b_stop AS VARCHAR), ',' ORDER BY i) FILTER (WHERE i >= first_new AND role = 'assistant'), '') AS rejected_spans
FROM s GROUP BY conv_id
"""


OP8_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first_id FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest,
  CASE WHEN n >= 100 AND first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM f
"""

OP9_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), g AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS g FROM w
), c AS (
  SELECT g, list_sort(g) AS k, doc_id, len(g) AS n, min(doc_id) OVER (PARTITION BY list_sort(g)) AS rep FROM g
), s AS (
  SELECT doc_id, n, unnest(g) AS g FROM c WHERE doc_id = rep AND n > 0
), l AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), r AS (
  SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
), m AS (
  SELECT a, least(a, min(b)) AS root FROM r GROUP BY a
)
SELECT c.doc_id, CAST(c.n AS BIGINT) AS n_shingles, CASE WHEN c.n = 0 THEN c.doc_id ELSE coalesce(m.root, c.rep) END AS component_id,
  c.n = 0 OR c.doc_id = coalesce(m.root, c.rep) AS kept
FROM c LEFT JOIN m ON c.rep = m.a
"""


def _op6_sql() -> str:
    """Spans by splitting texts at marked matches: pieces with even numbers are matches, and lengths before them give their places."""
    mark, found = "chr(57345)", []
    for k, r in enumerate(secret_scan.RULES):
        pattern = r.pattern
        if r.ignore_case:  # of ASCII letters only, in the keywords before the first bracket
            keywords, rest = pattern.split(")", 1)
            pattern = "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in keywords) + ")" + rest
        pattern = pattern.replace("'", "''")
        found.append(f"""SELECT doc_id, {k} AS rule, '{r.kind}' AS kind, start, start + length(piece) AS stop FROM (
  SELECT doc_id, j, piece, sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY j) - length(piece) AS start FROM (
    SELECT doc_id, unnest(p) AS piece, generate_subscripts(p, 1) AS j FROM (
      SELECT doc_id, string_split(regexp_replace(text, '{pattern}', {mark} || '\\0' || {mark}, 'g'), {mark}) AS p FROM t WHERE regexp_matches(text, '{pattern}'))))
WHERE j % 2 = 0 AND length(regexp_extract(piece, '{pattern}', {r.group})) >= {r.least}""")
    base = range(len(secret_scan.BASE_RULES))
    counts = ", ".join(f"count(*) FILTER (WHERE rule = {k}) AS n_{secret_scan.RULES[k].kind}" for k in base)
    span = "kind || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT)"
    return f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), s AS ({" UNION ALL ".join(found)})
SELECT t.doc_id, {counts}, sha256(coalesce(string_agg({span}, ',' ORDER BY start, rule) FILTER (WHERE rule <= {max(base)}), '')) AS base_sha256, coalesce(string_agg({span}, ',' ORDER BY start, rule), '') AS spans
FROM t LEFT JOIN s ON t.doc_id = s.doc_id GROUP BY t.doc_id"""


def oracle_sql() -> dict[str, str]:
    return {"op6_secret_scan": _op6_sql(), "op7_preference_chat": OP7_SQL, "op8_warc": OP8_SQL, "op9_near_dedup": OP9_SQL}
