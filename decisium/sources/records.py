"""Source records of many shapes into canonical rows.

Each source has one decoder from its parsed record (a variant) to
struct(context, question, options, gold, topic); the registry is ``DECODERS``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from decisium.functions.arrays import clean_options, default_probs
from decisium.functions.hashing import content_key, content_split
from decisium.functions.text import collapsed, stripped


def _text(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "string")


def _texts(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "array<string>")


def _int(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "int")


def choice_table(v: Column, path: str = "$.choices") -> tuple[Column, Column]:
    """(texts, labels) of choices given as an object of lists, a list of objects or a list of texts."""
    listed = F.try_variant_get(v, path, "array<variant>")
    objects = F.transform(listed, lambda x: F.try_variant_get(x, "$.text", "string"))
    plain = F.try_variant_get(v, path, "array<string>")
    is_objects = F.exists(listed, lambda x: F.startswith(F.schema_of_variant(x), F.lit("OBJECT")))
    texts = F.coalesce(_texts(v, path + ".text"), F.when(is_objects, objects), plain)
    labels = F.coalesce(_texts(v, path + ".label"), F.when(is_objects, F.transform(listed, lambda x: F.try_variant_get(x, "$.label", "string"))))
    letters = F.transform(texts, lambda x, i: F.char(F.lit(65) + i))
    return texts, F.transform(F.coalesce(labels, letters), lambda x: F.upper(stripped(x)))


def place(values: Column, value: Column) -> Column:
    """The first place of ``value``, from 0; null if it isn't there."""
    p = F.array_position(values, value)
    return F.when(p > 0, (p - 1).cast("int"))


def in_range(i: Column, options: Column) -> Column:
    return F.when((i >= 0) & (i < F.size(options)), i)


def _row(context: Column, question: Column, options: Column, gold: Column, topic: Column | None = None) -> Column:
    return F.struct(
        collapsed(context).alias("context"),
        collapsed(question).alias("question"),
        options.alias("options"),
        gold.cast("int").alias("gold"),
        (topic if topic is not None else F.lit(None).cast("string")).alias("topic"),
    )


def arc(v: Column) -> Column:
    texts, labels = choice_table(v)
    return _row(_text(v, "$.question"), F.lit("Which answer is right?"), texts, place(labels, F.upper(stripped(_text(v, "$.answerKey")))))


def mmlu_record(v: Column) -> Column:
    options = _texts(v, "$.choices")
    return _row(F.lit(""), _text(v, "$.question"), options, in_range(_int(v, "$.answer"), options), _text(v, "$.subject"))


def race(v: Column) -> Column:
    options = F.coalesce(_texts(v, "$.options"), _texts(v, "$.choices"))
    answer = stripped(_text(v, "$.answer"))
    by_text = place(F.transform(options, lambda o: F.upper(stripped(o))), F.upper(answer))
    by_letter = F.when(F.upper(answer).isin("A", "B", "C", "D"), F.ascii(F.upper(answer)) - 65)
    return _row(_text(v, "$.article"), _text(v, "$.question"), options, in_range(F.coalesce(by_text, by_letter), options))


def keyed_choices(v: Column) -> Column:
    """Open-book and common-sense records: a stem, choices with labels, an answer key."""
    texts, labels = choice_table(v)
    return _row(F.lit(""), F.coalesce(_text(v, "$.question_stem"), _text(v, "$.question")), texts, place(labels, F.upper(stripped(_text(v, "$.answerKey")))))


def sciq(v: Column) -> Column:
    options = F.array(_text(v, "$.correct_answer"), _text(v, "$.distractor1"), _text(v, "$.distractor2"), _text(v, "$.distractor3"))
    return _row(_text(v, "$.support"), _text(v, "$.question"), options, F.when(_text(v, "$.correct_answer").isNotNull(), F.lit(0)))


def hellaswag(v: Column) -> Column:
    options = _texts(v, "$.endings")
    return _row(_text(v, "$.ctx"), F.lit("How does it go on?"), options, in_range(F.coalesce(_int(v, "$.gold_label"), _int(v, "$.label")), options))


def medqa(v: Column) -> Column:
    options = F.array(*[_text(v, f"$.ending{i}") for i in range(4)])
    answer = F.upper(stripped(_text(v, "$.answer")))
    gold = F.coalesce(_int(v, "$.label"), F.when(answer.isin("A", "B", "C", "D"), F.ascii(answer) - 65))
    return _row(_text(v, "$.sent1"), F.coalesce(F.nullif(collapsed(_text(v, "$.sent2")), F.lit("")), F.lit("Which answer is right?")), options, in_range(gold, options))


def quality(v: Column) -> Column:
    options = _texts(v, "$.options")
    return _row(_text(v, "$.article"), _text(v, "$.question"), options, in_range(_int(v, "$.answer"), options))


def qasc(v: Column) -> Column:
    """The context is the supporting facts, else the combined one."""
    texts, labels = choice_table(v)
    given = F.transform(F.coalesce(F.try_variant_get(v, "$.supporting_facts", "array<variant>"), F.array().cast("array<variant>")), lambda x: collapsed(F.try_variant_get(x, "$.text", "string")))
    facts = F.array_join(F.filter(given, lambda x: x != ""), " ")
    context = F.coalesce(F.nullif(facts, F.lit("")), _text(v, "$.combined_fact"))
    return _row(context, _text(v, "$.question"), texts, place(labels, F.upper(stripped(_text(v, "$.answerKey")))))


def medmcqa(v: Column) -> Column:
    """The answer counts from 1; the topic is the subject's, else the topic's name."""
    options = F.array(*[_text(v, f"$.op{c}") for c in "abcd"])
    topic = F.coalesce(F.nullif(collapsed(_text(v, "$.subject_name")), F.lit("")), F.nullif(collapsed(_text(v, "$.topic_name")), F.lit("")))
    return _row(F.lit(""), _text(v, "$.question"), options, in_range(_int(v, "$.cop") - 1, options), topic)


def lettered(v: Column) -> Column:
    """Columns A to D and an answer letter."""
    options = F.array(*[_text(v, f"$.{c}") for c in "ABCD"])
    answer = F.upper(stripped(_text(v, "$.Answer")))
    return _row(F.lit(""), _text(v, "$.Question"), options, F.when(answer.isin("A", "B", "C", "D"), F.ascii(answer) - 65))


DECODERS: dict[str, Callable[[Column], Column]] = {
    "arc-challenge": arc,
    "mmlu-astronomy": mmlu_record,
    "race-middle": race,
    "openbookqa": keyed_choices,
    "commonsense": keyed_choices,
    "sciq": sciq,
    "hellaswag": hellaswag,
    "medqa": medqa,
    "quality_qa": quality,
    "qasc": qasc,
    "medmcqa": medmcqa,
    "mmlu": mmlu_record,
    "gsm_mc": lettered,
    "math_mc": lettered,
}
#: Accepted rows that an ingest takes of a source, where it has a limit.
# fixed values: the most rows that a source gives
CAPS = {"quality_qa": 6700, "qasc": 8134, "medmcqa": 30_000, "mmlu": 40_000, "gsm_mc": 7000, "math_mc": 7000}


def decode(df: DataFrame, source: str, column: str = "value") -> DataFrame:
    """``df`` with context, question, options, correct_index and topic of the records in ``column``; options cleaned, gold moved along."""
    row = DECODERS[source](F.try_parse_json(column))
    cleaned = clean_options("r.options", "r.gold")
    df = df.withColumn("r", row).withColumn("c", cleaned)
    return df.select(*[c for c in df.columns if c not in ("r", "c", column)], "r.context", "r.question", F.col("c.options").alias("options"), F.col("c.gold").alias("correct_index"), "r.topic")


def accepted(rows: DataFrame, cap: int | None = None, order: str = "seq") -> DataFrame:
    """Rows with a question, two options or more and a gold one; the first ``cap`` of them."""
    good = rows.filter((F.col("question") != "") & (F.size("options") >= 2) & F.col("correct_index").isNotNull())
    return good.orderBy(order).limit(cap) if cap else good


def canonical(rows: DataFrame, family: str, confidence: float = 0.95) -> DataFrame:
    """``rows`` with the fields every row has: a content id, task, difficulty, probabilities, family and tier."""
    key = content_key(F.lit(family), "context", "question", F.col("options"))
    return rows.withColumns(
        {"id": F.sha2(key, 256), "family": F.lit(family), "task": F.lit(family), "difficulty": F.lit("medium"), "tier": F.lit("fact"), "dataset": F.lit(family), "teacher_probs": default_probs(F.size("options"), "correct_index", confidence)}
    )


def ingest(spark: SparkSession, path: str, source: str, family: str, out: str, reserved: DataFrame | None = None, cap: int | None = None) -> dict[str, int]:
    """A whole run: scan JSON Lines of ``source`` records, keep answerable rows that ``reserved`` (key) doesn't hold, the first of
    each row key, ``cap`` of them at most, and write them as rows of ``family``; gives the run's counters from its own pass."""
    from decisium.operators import audit, keys, merge
    from decisium.runtime import materialise
    from decisium.sources.jsonl import read_numbered

    lines = read_numbered(spark, path)
    rows = decode(lines, source).withColumn("seq", F.concat(F.xxhash64("path").cast("string"), F.lit("/"), F.lpad(F.col("line").cast("string"), 12, "0")))
    rows, seen = audit.counted(rows, unanswerable=F.col("correct_index").isNull() | (F.col("question") == "") | (F.size("options") < 2))
    rows = materialise(accepted(rows).withColumn("key", keys.row_key()), "records")
    free = rows if reserved is None else merge.without(rows, reserved, "key")
    first = materialise(merge.first_per_key(free, "key"), "first")
    kept = first.orderBy("seq").limit(cap) if cap else first
    canonical(kept.drop("path", "line", "seq", "key"), family).write.mode("overwrite").json(out)
    found = seen.get
    return {"scanned": found["rows"], "unanswerable": found["unanswerable"], "reserved": rows.count() - free.count(), "duplicates": free.count() - first.count(), "written": min(first.count(), cap or first.count())}


def halves(rows: DataFrame, family: str, salt: str, fraction: float = 0.5) -> DataFrame:
    """``rows`` with pub_split, decided by a row's content alone."""
    return rows.withColumn("pub_split", content_split(content_key(F.lit(family), "context", "question", F.col("options")), salt, fraction))


def balanced_sample(rows: DataFrame, subject: str, per_subject: int, total: int, seed: int = 7, row_id: str = "id") -> DataFrame:
    """At most ``per_subject`` rows of a subject, then ``total`` in all, by hash order."""
    from decisium.functions.hashing import sha_order
    from decisium.operators.merge import hash_first

    limits = rows.select(subject).distinct().withColumn("most", F.lit(per_subject))
    return hash_first(rows, subject, limits, "drawn", seed, row_id).filter("drawn").drop("drawn").orderBy(sha_order(seed, row_id), row_id).limit(total)
