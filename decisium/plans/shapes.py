"""Queries over sources, pages, generators, replies and streams."""

from __future__ import annotations

import json
import re

from pyspark.sql import functions as F

from decisium.functions import wiki
from decisium.operators import mining, replies
from decisium.plans.base import PAGES, ROWS, decision_rows, n2, pages, query
from decisium.runtime import materialise, shared_path, table
from decisium.sources import records
from decisium.streaming import incremental


#: The fixture's lead and whole texts without markup.
LEAD = "title || ' is a country located in ' || region || ' and it was founded in ' || founded || '. It borders the ' || region || ' sea. It was ruled by a council of elders.'"
CLEAN = f"{LEAD} || ' == History == Its records were established by Ada ' || title || ' in the old port. Category:Countries in ' || region || ' Category:All stub articles Port'"
CATS = "'Countries in ' || region || '|Ports of ' || title"


@query("wiki_clean", f"WITH {PAGES} SELECT title, {CLEAN} AS clean FROM wiki")
def wiki_clean(spark, sf_dir):
    return pages(spark, sf_dir).select("title", wiki.clean_markup("text").alias("clean"))


@query("wiki_links", f"WITH {PAGES} SELECT title, 'Port ' || replace(title, '_', ' ') || '|the ' || region || ' sea' AS labels FROM wiki")
def wiki_links(spark, sf_dir):
    """Labels that differ from their targets; underscores are spaces, and categories aren't topics."""
    return pages(spark, sf_dir).select("title", F.array_join(wiki.link_labels("text"), "|").alias("labels"))


@query("wiki_categories", f"WITH {PAGES} SELECT title, {CATS} AS categories FROM wiki")
def wiki_categories(spark, sf_dir):
    return pages(spark, sf_dir).select("title", F.array_join(wiki.categories("text"), "|").alias("categories"))


BOXES = "(VALUES ('area_km2'), ('capital'), ('currency')) f(field)"
BOX_VALUE = "CASE field WHEN 'capital' THEN 'LINK' WHEN 'currency' THEN title || ' crown' ELSE CAST(1000 + seq * 37 AS VARCHAR) END"


@query("wiki_infobox", f"WITH {PAGES} SELECT title, field, {BOX_VALUE} AS vals FROM wiki, {BOXES}")
def wiki_infobox(spark, sf_dir):
    box = pages(spark, sf_dir).select("title", F.explode(wiki.infobox("text")).alias("field", "vals"))
    return box.select("title", "field", F.array_join("vals", "|").alias("vals"))


@query("wiki_short_description", f"WITH {PAGES} SELECT title, 'Country in ' || region AS short FROM wiki")
def wiki_short_description(spark, sf_dir):
    return pages(spark, sf_dir).select("title", wiki.short_description("text").alias("short"))


@query("wiki_balanced", f"WITH {PAGES} SELECT title, ' ' || chr(10) || ' ' || substr(text, strpos(text, chr(10) || '}}}}' || chr(10)) + 3) AS rest FROM wiki")
def wiki_balanced(spark, sf_dir):
    return pages(spark, sf_dir).select("title", wiki.without_templates("text").alias("rest"))


SEEDS = f"""seeds AS (SELECT title, seq, {LEAD} AS lead3, title || ' is a country located in ' || region || ' and it was founded in ' || founded || '.' AS lead1,
  'the ' || region || ' sea' AS links, {CATS} AS cats, region FROM wiki WHERE redirect_target IS NULL)"""


@query(
    "lead_def",
    f"""WITH {PAGES}, {SEEDS} SELECT title, lead1, lead3, lead1 AS def, links, cats,
  '{{"capital":["LINK"],"currency":["' || title || ' crown"],"area_km2":["' || CAST(1000 + seq * 37 AS VARCHAR) || '"]}}' AS box FROM seeds""",
)
def lead_def(spark, sf_dir):
    seeds = mining.seeds(pages(spark, sf_dir))
    return seeds.select("title", "lead1", "lead3", "def", F.array_join("links", "|").alias("links"), F.array_join("cats", "|").alias("cats"), F.to_json("box").alias("box"))


#: Sentences of 40 characters or more, packed one by one: a recursion over their places.
CHUNKS = f"""WITH RECURSIVE s AS (SELECT doc_id, list_filter(string_split(regexp_replace({n2("text")}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: length(x) >= 40) AS s FROM documents),
p AS (SELECT doc_id, s, 1 AS i, CAST([] AS VARCHAR[]) AS now, 0 AS n, CAST(NULL AS VARCHAR) AS made FROM s WHERE len(s) > 0
  UNION ALL SELECT doc_id, s, i + 1,
    CASE WHEN i > len(s) THEN [] WHEN len(now) > 0 AND (n + length(s[i]) > 700 OR len(now) >= 4) THEN [s[i]] ELSE list_append(now, s[i]) END,
    CASE WHEN i > len(s) THEN 0 WHEN len(now) > 0 AND (n + length(s[i]) > 700 OR len(now) >= 4) THEN length(s[i]) ELSE n + length(s[i]) END,
    CASE WHEN len(now) > 0 AND (i > len(s) OR n + length(s[i]) > 700 OR len(now) >= 4) THEN array_to_string(now, ' ') END
  FROM p WHERE i <= len(s) + 1),
k AS (SELECT doc_id, i, made FROM p WHERE made IS NOT NULL AND length(made) BETWEEN 180 AND 704 AND NOT regexp_matches(made, '\\{{\\{{|\\}}\\}}|\\[\\[|\\]\\]|<|>'))
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INT) AS chunk_no, made AS chunk FROM k"""


@query("chunks", CHUNKS)
def chunks(spark, sf_dir):
    """Passages of all documents, packed sentence by sentence."""
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(wiki.chunks("text")).alias("chunk_no", "chunk"))


@query("facts", f"WITH {PAGES} SELECT title, CAST(2 AS INT) AS sentence_no, 'number' AS kind, regexp_extract(title, '[0-9]+') AS answer FROM wiki")
def facts(spark, sf_dir):
    """The facts of whole pages: the numbers of their names, as their other sentences hold markup."""
    return mining.page_facts(pages(spark, sf_dir)).select("title", "sentence_no", "kind", "answer")


#: A sentence of each kind, of weak starts and of forms that have no fact, about a nation (n) of a region (r).
SENTENCES = [
    ("The old bridge of {n} was opened to all traffic in {y} by the mayor", "year", "{y}"),
    ("The (old) town hall of {n} has stood here since the {y} fire of the town", "year", "{y}"),
    ("The harbour of old {n} is situated in Port {n}, close to a wide river", "place", "Port {n}"),
    ("The lake of {n} holds {k} million boats in summer and none at all in winter", "number", "{k} million"),
    ("The lake of {n} holds {k}, and no more than that, of all boats in summer", "number", "{k},"),
    ("The abbey of {n} was founded by Hildegard {n}, a nun of great learning there", "who", "Hildegard {n}"),
    ("The abbey (of {n}, not {k}) was chaired by Ada {n}, for the whole of a century", "who", "Ada {n}"),
    ("The abbey of {n} was chaired by Ada O'Neil-Smith for the whole of a century", "who", "Ada O'Neil-Smith for"),
    ("The zither of {n} is a kind of string instrument", "cat", "string instrument"),
    ("When the bridge of {n} was opened to all traffic in {y}, none came", None, None),
    ("the bridge of {n} was opened to all traffic in {y} by the mayor of it", None, None),
    ("The bridge of {n} was opened in {y} and again in 1999 by an old mayor of {r}", None, None),
    ("Nothing at all to see here, in {n} or in {r}, on any day of the week", None, None),
]


def _of_nation(text: str | None, quoted: str, joined: str) -> str:
    """``text`` as an SQL expression."""
    if text is None:
        return "CAST(NULL AS STRING)"
    parts = re.split(r"\{(\w)\}", text)
    values = {"n": "translate(n_name, '_0123456789', ' ABCDEFGHIJ')", "r": "r_name", "y": "CAST(1500 + n_nationkey * 17 AS STRING)", "k": "CAST(3 + n_nationkey AS STRING)"}
    return joined.join(values[p] if i % 2 else quoted + p.replace(quoted, 2 * quoted) + quoted for i, p in enumerate(parts) if p)


FACT_ROWS = " UNION ALL ".join(
    f"SELECT {i} AS case_no, n_nationkey AS seq, '{kind}' AS kind, {_of_nation(answer, chr(39), ' || ')} AS answer FROM nation JOIN region ON n_regionkey = r_regionkey"
    for i, (_, kind, answer) in enumerate(SENTENCES)
    if kind
)


def sentence_facts(spark, sf_dir):
    """(case_no, seq, sentence, kind, answer) of ``SENTENCES``, one case for each nation."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    df = nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))
    cases = F.array(*[F.struct(F.lit(i).alias("case_no"), F.expr(_of_nation(text, '"', " || ")).alias("sentence")) for i, (text, _, _) in enumerate(SENTENCES)])
    rows = df.select(F.col("n_nationkey").alias("seq"), F.inline(cases)).filter(wiki.usable_sentence("sentence") | (F.length("sentence") < 50))
    return rows.withColumn("fact", wiki.facts("sentence")).filter("fact IS NOT NULL").select("case_no", "seq", "sentence", "fact.*")


@query("facts_kinds", FACT_ROWS)
def facts_kinds(spark, sf_dir):
    return sentence_facts(spark, sf_dir).drop("sentence")


def _place(key: str, n: str) -> str:
    return f"CAST('0x' || substr(sha256({key}), 1, 8) AS BIGINT) % {n}"


_DISTINCT = "SELECT 0 AS pool_key, list(v ORDER BY sha256('7|' || v), v) AS pool FROM (SELECT DISTINCT {v} AS v FROM seeds{more})"
_CATS = "['Countries in ' || region, 'Ports of ' || title]"
#: Of each family the rows asked about and the pools of wrong options.
MINED = {
    "define": (f"SELECT title, '{mining.QUESTIONS['define']} ' || title AS question, '' AS context, lead1 AS gold, CAST([] AS VARCHAR[]) AS exclude, 0 AS pool_key FROM seeds", _DISTINCT.format(v="lead1", more="")),
    "knowledge": (f"SELECT title, '{mining.QUESTIONS['knowledge']}' AS question, lead1 AS context, title AS gold, CAST([] AS VARCHAR[]) AS exclude, 0 AS pool_key FROM seeds", _DISTINCT.format(v="title", more="")),
    "wikicat": (
        f"SELECT title, '{mining.QUESTIONS['wikicat']}' AS question, lead3 AS context, {_CATS}[{_place("'7|' || title", '2')} + 1] AS gold, {_CATS} AS exclude, 0 AS pool_key FROM seeds",
        _DISTINCT.format(v="c.cat", more=f", unnest({_CATS}) c(cat)"),
    ),
    "wikiret": (f"SELECT title, '{mining.QUESTIONS['wikiret']}' AS question, lead3 AS context, links AS gold, [links] AS exclude, 0 AS pool_key FROM seeds", _DISTINCT.format(v="title", more="")),
    "wikibox": (
        "SELECT title, 'What is the ' || replace(field, '_', ' ') || ' of ' || title || '?' AS question, lead1 AS context, val AS gold, [val] AS exclude, field AS pool_key FROM boxes QUALIFY row_number() OVER (PARTITION BY title ORDER BY sha256('7|' || title || '|' || field)) <= 2",
        "SELECT field AS pool_key, list(DISTINCT val ORDER BY val) AS pool FROM boxes GROUP BY field HAVING count(DISTINCT val) >= 8",
    ),
}


def _mined_sql(family: str) -> str:
    asked, pools = MINED[family]
    key = f"'7|' || title || '|{family}'"
    return f"""WITH {PAGES}, {SEEDS}, boxes AS (SELECT title, lead1, field, {BOX_VALUE} AS val FROM seeds, {BOXES}), asked AS ({asked}), pools AS ({pools}),
d AS (SELECT a.*, list_concat(list_transform(range(0, 29), lambda i: pool[{_place(f"{key} || '|' || i", "len(pool)")} + 1]),
  list_transform(range(0, least(len(pool), 56)), lambda i: pool[({_place(key, "len(pool)")} + i) % len(pool) + 1])) AS drawn FROM asked a JOIN pools p ON a.pool_key = p.pool_key),
w AS (SELECT *, list_filter(drawn, lambda v, i: list_position(drawn, v) = i AND lower(v) <> lower(gold) AND NOT list_contains(list_transform(exclude, lambda e: lower(e)), lower(v)))[1:7] AS wrong FROM d),
o AS (SELECT *, list_concat([gold], wrong) AS every, list_sort(list_transform(range(0, 8), lambda i: sha256({key} || '|' || i) || '|' || i)) AS ks FROM w WHERE len(wrong) = 7)
SELECT '{family}' AS family, title, question, context, array_to_string(list_transform(ks, lambda k: every[CAST(split_part(k, '|', 2) AS INT) + 1]), '|') AS options,
  CAST(list_position(list_transform(ks, lambda k: split_part(k, '|', 2)), '0') - 1 AS INT) AS correct_index FROM o"""


def _mined(family):
    @query(f"mine_{family}", _mined_sql(family))
    def mine(spark, sf_dir):
        seeds = materialise(mining.seeds(pages(spark, sf_dir)), "seeds")
        rows = mining.mined_rows(seeds).filter(F.col("family") == family)
        return rows.select("family", "title", "question", "context", F.array_join("options", "|").alias("options"), "correct_index")


for _family in mining.FAMILIES:
    _mined(_family)

#: One record of each shape, and one that can't be answered (source, record).
RECORDS = [
    ("arc-challenge", {"question": "Q a", "choices": {"text": ["x", "y", "z"], "label": ["A", "B", "C"]}, "answerKey": "b"}),
    ("arc-challenge", {"question": "Q b", "choices": [{"text": "x", "label": "1"}, {"text": "y", "label": "2"}], "answerKey": "2"}),
    ("arc-challenge", {"question": "Q c", "choices": {"text": ["x", "y"], "label": ["A", "B"]}, "answerKey": "E"}),
    ("mmlu-astronomy", {"question": "Q d", "choices": ["p", "q", "r", "s"], "answer": 3, "subject": "astronomy"}),
    ("mmlu-astronomy", {"question": "Q e", "choices": ["p", "q"], "answer": 7}),
    ("race-middle", {"article": "Some text.", "question": "Q f", "options": ["one", "two", "three"], "answer": "C"}),
    ("race-middle", {"article": "Some text.", "question": "Q g", "options": ["one", "two", "three"], "answer": "TWO"}),
    ("openbookqa", {"question_stem": "Q h", "choices": {"text": ["x", "y"], "label": ["A", "B"]}, "answerKey": "A"}),
    ("commonsense", {"question": "Q i", "choices": {"text": ["x", "X ", "y"], "label": ["A", "B", "C"]}, "answerKey": "C"}),
    ("sciq", {"question": "Q j", "correct_answer": "good", "distractor1": "b1", "distractor2": "b2", "distractor3": "b3", "support": "why"}),
    ("hellaswag", {"ctx": "It began", "endings": ["e1", "e2", "e3", "e4"], "label": "2"}),
    ("medqa", {"sent1": "Case", "sent2": "Q k", "ending0": "e0", "ending1": "e1", "ending2": "e2", "ending3": "e3", "label": 1}),
    ("quality_qa", {"article": "Long text", "question": "Q l", "options": ["a", "b", "c", "d"], "answer": 0}),
    ("qasc", {"question": "Q m", "choices": {"text": ["x", "y"], "label": ["A", "B"]}, "answerKey": "B", "supporting_facts": [{"text": "f1"}, {"text": " f2 "}], "combined_fact": "c"}),
    ("medmcqa", {"question": "Q n", "opa": "a", "opb": "b", "opc": "c", "opd": "d", "cop": 4, "subject_name": " ", "topic_name": "T"}),
    ("mmlu", {"question": " Q  q ", "choices": ["p", "", "P", "s"], "answer": 3, "subject": "law"}),
    ("gsm_mc", {"Question": "Q o", "A": "1", "B": "2", "C": "3", "D": "4", "Answer": "c"}),
    ("math_mc", {"Question": "Q p", "A": "1", "B": "1", "C": "3", "D": "4", "Answer": "D"}),
]
_DECODED = [
    ("arc-challenge", "Q a", "Which answer is right?", "x|y|z", 1), ("arc-challenge", "Q b", "Which answer is right?", "x|y", 1), ("arc-challenge", "Q c", "Which answer is right?", "x|y", None),
    ("mmlu-astronomy", "", "Q d", "p|q|r|s", 3), ("mmlu-astronomy", "", "Q e", "p|q", None), ("race-middle", "Some text.", "Q f", "one|two|three", 2), ("race-middle", "Some text.", "Q g", "one|two|three", 1),
    ("openbookqa", "", "Q h", "x|y", 0), ("commonsense", "", "Q i", "x|y", 1), ("sciq", "why", "Q j", "good|b1|b2|b3", 0), ("hellaswag", "It began", "How does it go on?", "e1|e2|e3|e4", 2),
    ("medqa", "Case", "Q k", "e0|e1|e2|e3", 1), ("quality_qa", "Long text", "Q l", "a|b|c|d", 0), ("qasc", "f1 f2", "Q m", "x|y", 1), ("medmcqa", "", "Q n", "a|b|c|d", 3), ("mmlu", "", "Q q", "p|s", 1), ("gsm_mc", "", "Q o", "1|2|3|4", 2), ("math_mc", "", "Q p", "1|3|4", 2),
]


def _values(rows) -> str:
    show = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return "VALUES " + ", ".join("(" + ", ".join(map(show, r)) + ")" for r in rows)


def _decoder(source):
    rows = [r for r in _DECODED if r[0] == source]

    @query(f"source_{source.replace('-', '_')}", f"SELECT * FROM ({_values(rows)}) t(source, context, question, options, correct_index)")
    def decoded(spark, sf_dir):
        found = [(i, json.dumps(r)) for i, (s, r) in enumerate(RECORDS) if s == source]
        df = records.decode(spark.createDataFrame(found, "seq long, value string"), source)
        return df.select(F.lit(source).alias("source"), "context", "question", F.array_join("options", "|").alias("options"), "correct_index")


for _source in records.DECODERS:
    _decoder(_source)


def _requests(spark, sf_dir):
    """All decision rows with a seq of their own, eight to a request, and replies that change some of them."""
    df = replies.batches(decision_rows(spark, sf_dir), 8)
    q = F.when(F.col("seq") % 5 == 0, F.col("question")).otherwise(F.concat(F.lit("Say: "), F.col("question")))
    o = F.when(F.col("request_id") % 4 == 1, F.slice("options", 1, 3)).otherwise(F.col("options"))
    row = F.struct("pos", F.struct(q.alias("question"), o.alias("options"), "correct_index").alias("row"))
    per = df.groupBy("request_id").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    body = F.concat(F.lit("Here you are: "), F.to_json(F.transform("rows", lambda r: r["row"])), F.lit(" done"))
    return df, per.select("request_id", F.when(F.col("request_id") % 4 == 2, "no rows today").otherwise(body).alias("reply"))


@query("accept_variator", f"WITH {ROWS} SELECT CAST(seq // 8 AS BIGINT) AS request_id, (seq // 8) % 4 NOT IN (1, 2) AS accepted FROM rows0 GROUP BY 1, 2")
def accept_variator(spark, sf_dir):
    df, completions = _requests(spark, sf_dir)
    return replies.accept_variations(df, replies.reply_rows(completions))


@query("accept_reformulate", f"WITH {ROWS} SELECT id, (seq // 8) % 4 NOT IN (1, 2) AND seq % 5 <> 0 AS accepted FROM rows0")
def accept_reformulate(spark, sf_dir):
    df, completions = _requests(spark, sf_dir)
    return replies.reformulated(df, replies.reply_rows(completions))


@query("accept_near_miss")
def accept_near_miss(spark, sf_dir):
    df, _ = _requests(spark, sf_dir)
    df = df.withColumn("options", F.transform("options", lambda o: F.concat(F.lit("the language called "), o))).withColumn("near_miss_target", F.lit(1))
    changed = F.transform("options", lambda o, i: F.when((i == 1) & (F.col("seq") % 2 == 0), F.concat(o, F.lit(" or so"))).otherwise(o))
    row = F.struct("pos", F.struct("question", changed.alias("options"), "correct_index").alias("row"))
    per = df.groupBy("request_id").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    completions = per.select("request_id", F.to_json(F.transform("rows", lambda r: r["row"])).alias("reply"))
    return replies.near_misses(df, replies.reply_rows(completions))


@query("rewrite_fallback", f"WITH {ROWS} SELECT id, coalesce(correct_index = seq % 4, false) AS rewritten FROM rows0")
def rewrite_fallback(spark, sf_dir):
    df = decision_rows(spark, sf_dir).withColumn("reply", F.concat(F.char(F.lit(65) + F.col("seq") % 4), F.lit(")"))).withColumn("reply", F.concat(F.lit("("), F.col("reply"))).withColumn("new_context", F.lit("new"))
    return replies.reanswered(df).select("id", "rewritten")


@query("prompt_requests", f"WITH {ROWS} SELECT CAST(seq // 8 AS BIGINT) AS request_id, 'Write 8 rows of the family ' || min(family) || '. Answer with a JSON array of objects.' AS system, count(*) AS n FROM rows0 GROUP BY 1")
def prompt_requests(spark, sf_dir):
    df, _ = _requests(spark, sf_dir)
    p = replies.prompts(df)
    n = F.size(F.try_variant_get(F.try_parse_json("user"), "$", "array<variant>"))
    return p.select("request_id", "system", n.cast("long").alias("n"))


@query("worker_specs", "SELECT * FROM (VALUES ('a', 'p', 2, 10, 'o', 8, 4096, 0.7::DOUBLE, true), ('b', 'q', 1, 5, 'r', 4, 100, 0.2::DOUBLE, true), ('c', NULL, NULL, NULL, NULL, 8, 4096, 0.7::DOUBLE, false)) t(name, provider, n_models, per_family, out, count, max_tokens, temperature, valid)")
def worker_specs(spark, sf_dir):
    lines = [("a|p|m1,m2|f|10|o",), ("b|q|m|f,g|5|r|4|100|0.2",), ("c",)]
    df = replies.worker_specs(spark.createDataFrame(lines, "value string"))
    return df.select("name", "provider", F.when(F.col("models").isNotNull(), F.size("models")).alias("n_models"), "per_family", "out", "count", "max_tokens", "temperature", "valid")


@query("workers_done", f"WITH {ROWS}, c AS (SELECT family, count(*) AS n FROM rows0 GROUP BY family) SELECT bool_and(n >= 20) AS done, round(100.0::DOUBLE * sum(least(n, 20)) / (count(*) * 20), 6) AS percent FROM c")
def workers_done(spark, sf_dir):
    return replies.all_done(decision_rows(spark, sf_dir).groupBy("family").agg(F.count("*").alias("n")), 20)


def _stream(spark, sf_dir, name):
    """The table as a stream of several files."""
    folder = shared_path(spark, f"stream-{name}")
    df = table(spark, sf_dir, name)
    df.repartition(4).write.parquet(folder)
    return incremental.read_new_files(spark, folder, df.schema)


@query("stream_progress", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def stream_progress(spark, sf_dir):
    name = "progress_" + shared_path(spark, "x").rpartition("-")[2]
    incremental.to_table(incremental.progress(_stream(spark, sf_dir, "events"), "event_type"), name, "complete", shared_path(spark, "state")).awaitTermination()
    return spark.table(name)


@query("stream_dedup", "SELECT count(*) AS n, CAST(sum(user_id) AS BIGINT) AS total FROM (SELECT DISTINCT user_id FROM events)")
def stream_dedup(spark, sf_dir):
    name = "dedup_" + shared_path(spark, "x").rpartition("-")[2]
    incremental.to_table(incremental.without_repeats(_stream(spark, sf_dir, "events").select("user_id"), "user_id"), name, "append", shared_path(spark, "state")).awaitTermination()
    return spark.table(name).agg(F.count("*").alias("n"), F.sum("user_id").alias("total"))


@query("stream_append", "SELECT count(*) AS n, round(sum(value), 4) AS total FROM events")
def stream_append(spark, sf_dir):
    out = shared_path(spark, "appended")
    incremental.append_once(_stream(spark, sf_dir, "events"), out, shared_path(spark, "state")).awaitTermination()
    return spark.read.parquet(out).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("stream_windows", "SELECT event_type, time_bucket(INTERVAL 1 hour, ts) AS start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_windows(spark, sf_dir):
    """Tumbling totals (an addition): the batch form of the streaming plan gives the same rows."""
    df = incremental.windowed_totals(table(spark, sf_dir, "events"))
    return df.select("event_type", F.col("window.start").alias("start"), "n", F.round("total", 4).alias("total"))
