"""The relational shell around model calls: prompts, replies, acceptance.

The call itself is a table ``completions(request_id, reply)``; nothing here talks to
an endpoint.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from decisium.functions.text import json_array_text, normal, parsed_choice, similarity
from decisium.operators.validate import accept_reformulation, near_miss_ok
from decisium.runtime import materialise

INSTRUCTION = "Write {count} rows of the family {family}. Answer with a JSON array of objects."


def batches(df: DataFrame, size: int, order: str = "seq") -> DataFrame:
    """``df`` with request_id and pos: neighbouring rows share a request."""
    return df.withColumn("request_id", F.floor(F.col(order) / size).cast("long")).withColumn("pos", F.pmod(F.col(order), F.lit(size)).cast("int"))


def prompts(df: DataFrame, count: int = 8) -> DataFrame:
    """(request_id, system, user): the instruction of a request and its rows as JSON, in order."""
    row = F.struct("pos", F.struct("id", "context", "question", "options", "correct_index").alias("row"))
    per = df.groupBy("request_id").agg(F.sort_array(F.collect_list(row)).alias("rows"), F.min("family").alias("family"))
    system = F.replace(F.replace(F.lit(INSTRUCTION), F.lit("{count}"), F.lit(str(count))), F.lit("{family}"), F.col("family"))
    return per.select("request_id", system.alias("system"), F.to_json(F.transform("rows", lambda r: r["row"])).alias("user"))


# fixed values: the numbers of options that a family's requests ask for, in turn
OPTION_COUNTS = {
    "retrieval": (8, 8, 8, 8, 4, 4, 4, 4, 5, 6, 7),
    "permuted": (8, 8, 8, 8, 4, 4, 4, 4, 5, 6, 7),
    "paraphrase": (8, 8, 8, 4, 4, 5, 6, 7),
    "order": (8, 8, 8, 4, 4, 5, 6, 7),
    "define": (8, 8, 8, 4, 4, 5, 6, 7),
    "analogy": (8, 8, 8, 4, 4, 5, 6, 7),
    "cause": (8, 8, 8, 4, 4, 5, 6, 7),
    "summary": (8, 8, 8, 4, 4, 5, 6, 7),
    "knowledge": (8, 8, 8, 4, 4, 5, 6, 7),
    "consistency": (8, 8, 8, 4, 4, 5, 6, 7),
    "intent": (8, 8, 8, 8, 4, 5, 6, 7),
    "tone": (2, 3, 4, 5, 6),
    "ambiguity": (2, 3, 4, 5, 6),
    "open": (8, 8, 8, 4, 4, 4, 2, 3, 5, 6, 7),
    "longread": (4, 4, 4, 4, 2, 3, 5, 6),
    "chain_arithmetic": (8, 8, 8, 4, 4, 4, 2, 3, 5, 6, 7),
    "chain_logic": (8, 8, 8, 4, 4, 4, 2, 3, 5, 6, 7),
    "chain_sequence": (8, 8, 8, 4, 4, 4, 2, 3, 5, 6, 7),
    "chain_retrieval": (8, 8, 8, 4, 4, 4, 2, 3, 5, 6, 7),
    "reformulate": (8, 8, 8, 4, 4, 5, 6, 7),
    "near_miss": (8, 8, 8, 4, 4, 5, 6, 7),
}
#: What each family's rows are about, in this package's own words.
INSTRUCTIONS = {
    "retrieval": "State several facts in the context and ask for one of them; the other options are facts of the same kind.",
    "permuted": "As retrieval, but give the options in another order than the context does.",
    "paraphrase": "Give a sentence and ask which option says the same in other words.",
    "order": "Tell a few events in order and ask what happened first, last, before or after.",
    "define": "Name a word and ask what it means.",
    "analogy": "Give a pair of words and ask for the partner of a third.",
    "cause": "Describe a situation and ask for its most likely cause or effect.",
    "summary": "Give a short passage and ask which option sums it up.",
    "knowledge": "Ask for a fact that most people know; leave the context empty.",
    "consistency": "Give a passage and ask which option agrees with all of it.",
    "intent": "Give what somebody says and ask what they want.",
    "tone": "Give what somebody says and ask how they feel about it.",
    "ambiguity": "Write a passage that leaves the question open; there is no right option, and probabilities are spread.",
    "open": "Ask any question that fits the topic, easy or hard.",
    "longread": "Write a passage of several paragraphs and ask for something that only careful reading gives.",
    "chain_arithmetic": "Tell a small story whose answer takes the given calculation.",
    "chain_logic": "State the given implications and ask for what follows in the end.",
    "chain_sequence": "Name the given items in order and ask for the one at the given distance.",
    "chain_retrieval": "State the given value and its change, and ask for the result.",
    "reformulate": "Ask the same question in other words; options and gold stay.",
    "near_miss": "Change the named option a little, so that it is nearly but not quite another one.",
}
SYSTEM = "You write rows of multiple-choice training data. Answer with one JSON array of objects and nothing else."


def family_requests(df: DataFrame, count: int = 5) -> DataFrame:
    """``df`` (family, call_no, topic or null) with n_options, system and user; families without an instruction are left out.

    The number of options goes through the family's cycle by call_no.
    """
    table = lambda d: F.create_map(*[x for k, v in d.items() for x in (F.lit(k), v)])
    family = F.lower(F.trim("family"))
    counts = F.element_at(table({k: F.array(*[F.lit(n) for n in v]) for k, v in OPTION_COUNTS.items()}), family)
    said = F.element_at(table({k: F.lit(v) for k, v in INSTRUCTIONS.items()}), family)
    df = df.withColumn("n_options", F.get(counts, F.pmod(F.col("call_no"), F.size(counts)).cast("int"))).withColumn("said", said).filter("said is not null")
    topic = F.when(F.coalesce(F.col("topic"), F.lit("")) != "", F.concat(F.lit("\nAll rows are about "), F.col("topic"), F.lit("."))).otherwise("")
    user = F.concat(F.col("said"), F.lit(f"\nWrite {count} rows of "), F.col("n_options").cast("string"), F.lit(" options each, the options in random order."), topic)
    return df.withColumn("system", F.lit(SYSTEM)).withColumn("user", user).drop("said")


def reply_text(reply: Column) -> Column:
    """The text of a reply of any provider's shape: plain, wrapped in data, content as text or parts, else its reasoning."""
    v = F.try_parse_json(reply)
    body = F.coalesce(F.try_variant_get(v, "$.data", "variant"), v)
    message = "$.choices[0].message"
    parts = F.array_join(F.transform(F.try_variant_get(body, f"{message}.content", "array<variant>"), lambda p: F.try_variant_get(p, "$.text", "string")), "")
    plain = F.when(~F.startswith(F.coalesce(F.schema_of_variant(F.try_variant_get(body, f"{message}.content", "variant")), F.lit("")), F.lit("ARRAY")), F.try_variant_get(body, f"{message}.content", "string"))
    found = F.coalesce(F.nullif(parts, F.lit("")), F.nullif(plain, F.lit("")), F.try_variant_get(body, f"{message}.reasoning", "string"))
    return F.when(F.startswith(F.coalesce(F.schema_of_variant(v), F.lit("")), F.lit("OBJECT")), found).otherwise(reply)


def reply_rows(completions: DataFrame, reply: str = "reply") -> DataFrame:
    """(request_id, pos, n, item): the objects of each reply's array; a reply without one gives a row with pos -1."""
    parsed = F.try_variant_get(F.try_parse_json(json_array_text(reply)), "$", "array<variant>")
    df = completions.withColumn("items", F.coalesce(parsed, F.array().cast("array<variant>")))
    rows = df.select("request_id", F.size("items").alias("n"), F.posexplode_outer("items").alias("pos", "item"))
    return rows.withColumn("pos", F.coalesce("pos", F.lit(-1)))


def item_fields(item: Column) -> dict[str, Column]:
    return {
        "new_context": F.try_variant_get(item, "$.context", "string"),
        "new_question": F.try_variant_get(item, "$.question", "string"),
        "new_options": F.try_variant_get(item, "$.options", "array<string>"),
        "new_gold": F.try_variant_get(item, "$.correct_index", "int"),
        "support_span": F.try_variant_get(item, "$.support_span", "string"),
    }


def matched(source: DataFrame, rows: DataFrame) -> DataFrame:
    """Source rows and their reply items, by request and position."""
    answer = rows.select(F.col("request_id").alias("r_id"), F.col("pos").alias("r_pos"), F.col("n").alias("n_reply"), "item")
    df = source.join(answer, (F.col("request_id") == F.col("r_id")) & (F.col("pos") == F.col("r_pos")), "left").drop("r_id", "r_pos")
    return df.withColumns(item_fields(F.col("item")))


def accept_variations(source: DataFrame, rows: DataFrame) -> DataFrame:
    """Per request whether its reply has as many rows, each with as many options: all or nothing."""
    df = matched(source, rows)
    return df.groupBy("request_id").agg(
        (F.bool_and(F.coalesce(F.size("new_options") == F.size("options"), F.lit(False))) & (F.coalesce(F.max("n_reply"), F.lit(0)) == F.count("*"))).alias("accepted")
    )


def reformulated(source: DataFrame, rows: DataFrame) -> DataFrame:
    """(id, accepted): a new question with the same options and gold."""
    df = matched(source, rows)
    ok = accept_reformulation(F.col("new_question"), F.col("question"), F.col("new_options"), F.col("options"), F.col("new_gold"), F.col("correct_index"))
    return df.select("id", F.coalesce(ok, F.lit(False)).alias("accepted"))


def near_misses(source: DataFrame, rows: DataFrame, target: str = "near_miss_target") -> DataFrame:
    """(id, accepted): one option changed into a similar one, gold and all others as they were."""
    df = matched(source, rows)
    same = F.size("new_options") == F.size("options")
    others = F.forall(F.sequence(F.lit(0), F.size("options") - 1), lambda i: (i == F.col(target)) | (normal(F.get("new_options", i)) == normal(F.get("options", i))))
    new, old = F.get("new_options", F.col(target)), F.get("options", F.col(target))
    df = df.withColumn("ratio", similarity(new, old))
    ok = same & others & F.col("new_gold").eqNullSafe(F.col("correct_index")) & near_miss_ok(F.col("ratio"), new, old)
    return df.select("id", F.coalesce(ok, F.lit(False)).alias("accepted"))


def reanswered(rewrites: DataFrame) -> DataFrame:
    """(id, context, rewritten): the rewrite where the model still finds the gold option, else the original."""
    choice = parsed_choice("reply", F.size("options"))
    ok = F.coalesce(choice == F.col("correct_index"), F.lit(False)) & (F.coalesce(F.col("new_context"), F.lit("")) != "")
    return rewrites.select("id", F.when(ok, F.col("new_context")).otherwise(F.col("context")).alias("context"), ok.alias("rewritten"))


def worker_specs(df: DataFrame, column: str = "value") -> DataFrame:
    """name|provider|models|families|per_family|out[|count|max_tokens|temperature] as columns; short lines give nulls."""
    p = F.split(column, r"\|")
    at = lambda i: F.nullif(F.trim(F.try_element_at(p, F.lit(i))), F.lit(""))
    return df.select(
        at(1).alias("name"),
        at(2).alias("provider"),
        F.split(at(3), ",").alias("models"),
        F.split(at(4), ",").alias("families"),
        at(5).try_cast("int").alias("per_family"),
        at(6).alias("out"),
        F.coalesce(at(7).try_cast("int"), F.lit(8)).alias("count"),
        F.coalesce(at(8).try_cast("int"), F.lit(4096)).alias("max_tokens"),
        F.coalesce(at(9).try_cast("double"), F.lit(0.7)).alias("temperature"),
        F.size(p).between(6, 9).alias("valid"),
    )


def all_done(counts: DataFrame, need: int) -> DataFrame:
    """(done, percent) over (family, n): every family has what it needs."""
    return counts.agg(F.bool_and(F.col("n") >= need).alias("done"), F.round(100.0 * F.sum(F.least("n", F.lit(need))) / (F.count("*") * need), 6).alias("percent"))


#: Statuses after which a request may be sent again.
AGAIN = (429, 500, 502, 503, 504)


def answered(requests: DataFrame, call: Callable[[DataFrame, int], DataFrame], tries: int = 5, wait: float = 2.0, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """(request_id, status, reply, tries): every request once, with its last reply.

    ``call`` (pending requests, number of the round) gives (request_id, status, reply); one
    that gives none counts as status 503. Those whose status is in ``AGAIN`` are sent again
    after ``wait`` seconds, doubled each round. What came is written after each round, so
    only pending requests are repeated.
    """
    pending, done = requests, None
    for k in range(tries):
        if k:
            sleep(wait * 2 ** (k - 1))
        replies = call(pending, k).select(F.col("request_id").alias("reply_id"), "status", "reply")
        sent = pending.join(replies, F.col("request_id") == F.col("reply_id"), "left").withColumn("status", F.coalesce("status", F.lit(503)))
        sent = materialise(sent.withColumn("tries", F.lit(k + 1)), "round")
        again = F.col("status").isin(*AGAIN) if k + 1 < tries else F.lit(False)
        came = sent.filter(~again).select("request_id", "status", "reply", "tries")
        done = came if done is None else done.unionByName(came)
        pending = sent.filter(again).select(*requests.columns)
        if pending.isEmpty():
            break
    return done


def supervise(work: Callable[[DataFrame], None], counts: Callable[[], DataFrame], need: int, most_restarts: int = 50, wait: float = 20.0, sleep: Callable[[float], None] = time.sleep) -> int:
    """Run ``work`` on (family, missing) until every family of ``counts`` (family, n) has ``need`` rows; gives the number of runs.

    Work that fails is run again on what is still missing then: rows that it wrote count.
    After ``most_restarts`` restarts its last error is raised.
    """
    failed: Exception | None = None
    for k in range(most_restarts + 1):
        missing = counts().filter(F.col("n") < need).select("family", (F.lit(need) - F.col("n")).alias("missing"))
        if missing.isEmpty():
            return k
        if k:
            sleep(wait)
        try:
            work(missing)
        except Exception as e:
            failed = e
    if counts().filter(F.col("n") < need).isEmpty():
        return most_restarts + 1
    raise failed or RuntimeError("families are still short of rows")
