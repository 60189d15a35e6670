"""Mining pages: seeds, facts, pools, distractors, five row families."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from decisium.functions import wiki
from decisium.functions.hashing import sha_order, sha_place
from decisium.operators.merge import hash_first
from decisium.runtime import materialise


def seeds(pages: DataFrame) -> DataFrame:
    """(title, seq, lead1, lead3, def, links, cats, box) of each page that has something to ask about.

    Cheap filters come first: redirects, empty and disambiguation pages never reach the Arrow function.
    """
    marked = F.contains("text", F.lit("{{disambiguation")) | F.contains("text", F.lit("{{dab"))
    usable = pages.filter(F.col("redirect_target").isNull() & (F.col("title") != "") & (F.col("text") != "") & ~marked)
    lead = wiki.lead_text("text")
    df = usable.select(
        "title", "seq", lead.alias("lead"), wiki.clean_markup(lead).alias("clean"),
        wiki.short_description("text").alias("short"), wiki.categories("text").alias("cats"), wiki.infobox("text").alias("box"),
    )
    df = df.withColumn("sentences", wiki.sentences_of("clean")).withColumn("lead3", F.substring("clean", 1, 520))
    df = df.select(
        "title",
        "seq",
        F.substring(F.coalesce(F.get("sentences", F.lit(0)), F.lit("")), 1, 260).alias("lead1"),
        "lead3",
        wiki.definition(F.col("sentences"), F.col("short")).alias("def"),
        F.slice(F.filter(wiki.link_labels("lead"), lambda x: F.contains(F.lower("lead3"), F.lower(x))), 1, 5).alias("links"),
        "cats",
        "box",
        "short",
    )
    return df.filter(F.col("def").isNotNull() | (F.size("links") > 0) | (F.size("cats") > 0) | (F.size("box") > 0) | (F.col("short") != "")).drop("short")


def page_facts(pages: DataFrame) -> DataFrame:
    """(title, seq, sentence_no, sentence, kind, answer): at most one fact a sentence; sentences with markup left have none."""
    parts = F.transform(wiki.plain_sentences("text"), wiki.clean_sentence)
    rows = pages.select("title", "seq", F.posexplode(parts).alias("sentence_no", "sentence"))
    return rows.filter(wiki.usable_sentence("sentence")).withColumn("fact", wiki.facts("sentence")).filter(F.col("fact").isNotNull()).select("title", "seq", "sentence_no", "sentence", "fact.*")


def pool(values: DataFrame, column: str, most: int = 5000, seed: int = 7) -> DataFrame:
    """One row with ``pool``: at most ``most`` distinct values in seeded order (a bounded pool is the feature)."""
    top = values.select(F.col(column).alias("v")).filter("v is not null").distinct().orderBy(sha_order(seed, "v"), "v").limit(most)
    return top.agg(F.sort_array(F.collect_list(F.struct(sha_order(seed, "v").alias("k"), "v"))).alias("p")).select(F.transform("p", lambda s: s["v"]).alias("pool"))


def distractors(values: Column, gold: Column, exclude: Column, n: int, seed: int, *ids: Column) -> Column:
    """``n`` distinct members of the array ``values`` unlike gold and ``exclude`` (ignoring case), from hashed places.

    Oversampled places come first, then the pool from a hashed offset on, so small pools are used up exactly.
    """
    size = F.greatest(F.size(values), F.lit(1))
    drawn = F.transform(F.sequence(F.lit(0), F.lit(4 * n)), lambda i: F.get(values, sha_place(seed, size, *ids, i)))
    turn = sha_place(seed, size, *ids)
    rest = F.transform(F.sequence(F.lit(0), F.least(F.size(values), F.lit(8 * n)) - 1), lambda i: F.get(values, F.pmod(turn + i, size)))
    low = F.array_append(F.transform(exclude, F.lower), F.lower(gold))
    return F.slice(F.filter(F.array_distinct(F.concat(drawn, rest)), lambda v: v.isNotNull() & ~F.array_contains(low, F.lower(v))), 1, n)


def with_options(df: DataFrame, gold: str, wrong: str, seed: int, *ids: str) -> DataFrame:
    """``df`` with options (gold and wrong in seeded order) and correct_index."""
    every = F.concat(F.array(F.col(gold)), F.col(wrong))
    order = F.array_sort(F.transform(every, lambda v, i: F.struct(F.sha2(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in ids], i.cast("string")), 256).alias("k"), v.alias("v"), i.alias("i"))))
    df = df.withColumn("ordered", order)
    return df.withColumn("options", F.transform("ordered", lambda s: s["v"])).withColumn("correct_index", (F.array_position(F.transform("ordered", lambda s: s["i"]), 0) - 1).cast("int")).drop("ordered")


FACT_QUESTIONS = {
    "year": ("Which year does the passage give?", "When was this?"),
    "place": ("Where is it, by the passage?",),
    "number": ("Which number does the passage give?", "What figure is stated?"),
    "who": ("Who is named as the one that did this?",),
    "cat": ("What kind of thing is it?", "To which kind does it belong?"),
}


def fact_rows(facts: DataFrame, seed: int = 7, n_options: int = 8, tries: int = 40) -> DataFrame:
    """(title, kind, context, question, options, correct_index) of facts (title, sentence_no, sentence, kind, answer).

    Wrong options come from the answers of the same kind in drawn order (a bounded pool),
    then from made ones: years from 1500 to 2030, ports, numbers, names, words. Places
    that hold one another never meet. Every draw is a hash of title, sentence and its use.
    """
    ids = [F.col("title"), F.col("sentence_no")]

    def letter(first: str, n: int, i: Column, name: str) -> Column:
        return F.char(F.lit(ord(first)) + sha_place(seed, F.lit(n), *ids, F.lit(name), i))

    def number(low: int, high: int, i: Column, name: str = "n") -> Column:
        return (sha_place(seed, F.lit(high - low + 1), *ids, F.lit(name), i) + low).cast("string")

    made = {
        "year": lambda i: number(1500, 2030, i),
        "place": lambda i: F.concat(F.lit("Port "), letter("A", 10, i, "a"), number(1, 99, i)),
        "number": lambda i: number(1, 10_000, i),
        "who": lambda i: F.concat(letter("A", 13, i, "a"), letter("a", 13, i, "b"), number(10, 99, i)),
        "cat": lambda i: F.concat(letter("a", 13, i, "a"), letter("a", 13, i, "b"), F.lit(" "), number(1, 99, i)),
    }
    places = F.sequence(F.lit(0), F.lit(tries - 1))
    out = []
    for kind, questions in FACT_QUESTIONS.items():
        df = facts.filter(F.col("kind") == kind)
        own = F.array().cast("array<string>")
        if kind != "year":
            df = df.join(F.broadcast(pool(df, "answer", seed=seed)), F.lit(True))
            own = F.transform(places, lambda i: F.get("pool", sha_place(seed, F.greatest(F.size("pool"), F.lit(1)), *ids, F.lit("p"), i)))
        wrong = F.filter(F.array_distinct(F.concat(own, F.transform(places, made[kind]))), lambda v: v != F.col("answer"))
        if kind == "place":
            wrong = F.filter(wrong, lambda v: ~F.contains(F.col("answer"), v) & ~F.contains(v, F.col("answer")))
        question = F.get(F.array(*[F.lit(q) for q in questions]), sha_place(seed, F.lit(len(questions)), *ids, F.lit("q")))
        out.append(df.select("title", "sentence_no", "kind", F.col("sentence").alias("context"), question.alias("question"), "answer", F.slice(wrong, 1, n_options - 1).alias("wrong")))
    rows = out[0]
    for more in out[1:]:
        rows = rows.unionByName(more)
    rows = with_options(rows.filter(F.size("wrong") == n_options - 1), "answer", "wrong", seed, "title", "sentence_no")
    return rows.select("title", "kind", "context", "question", "options", "correct_index")


FAMILIES = ("define", "knowledge", "wikicat", "wikibox", "wikiret")
QUESTIONS = {
    "define": "Which description fits the topic named here?",
    "knowledge": "Which topic does this description belong to?",
    "wikicat": "To which category does this page belong?",
    "wikiret": "Which topic occurs in this passage?",
}


def mined_rows(seed_rows: DataFrame, seed: int = 7, n_options: int = 8, caps: dict[str, int] | None = None) -> DataFrame:
    """(family, title, context, question, options, correct_index) of the five mined families.

    Pools come first and are used whole; each is one row of bounded size, sent to every task.
    """
    wrong = n_options - 1

    def with_pool(df: DataFrame, values: DataFrame, column: str) -> DataFrame:
        return df.join(F.broadcast(pool(values, column, seed=seed)), F.lit(True))

    def asked(df: DataFrame, family: str, question: Column, context: Column, gold: Column, exclude: Column) -> DataFrame:
        df = df.select(F.lit(family).alias("family"), "title", "seq", context.alias("context"), question.alias("question"), gold.alias("gold"), distractors(F.col("pool"), gold, exclude, wrong, seed, F.col("title"), F.lit(family)).alias("wrong"))
        return with_options(df.filter(F.size("wrong") == wrong), "gold", "wrong", seed, "title", "family").drop("gold", "wrong")

    none = F.array().cast("array<string>")
    has_def = seed_rows.filter(F.col("def").isNotNull())
    out = [
        asked(with_pool(has_def, has_def, "def"), "define", F.concat(F.lit(QUESTIONS["define"] + " "), F.col("title")), F.lit(""), F.col("def"), none),
        asked(with_pool(has_def, seed_rows, "title"), "knowledge", F.lit(QUESTIONS["knowledge"]), F.col("def"), F.col("title"), none),
    ]
    cats = seed_rows.filter(F.size("cats") > 0).withColumn("own", F.get("cats", sha_place(seed, F.size("cats"), "title")))
    every_cat = seed_rows.select(F.explode("cats").alias("cat"))
    out.append(asked(with_pool(cats, every_cat, "cat"), "wikicat", F.lit(QUESTIONS["wikicat"]), F.col("lead3"), F.col("own"), F.col("cats")))
    links = seed_rows.filter(F.size("links") > 0).withColumn("own", F.get("links", F.lit(0)))
    out.append(asked(with_pool(links, seed_rows, "title"), "wikiret", F.lit(QUESTIONS["wikiret"]), F.col("lead3"), F.col("own"), F.col("links")))
    boxes = seed_rows.select("title", "seq", "lead1", F.explode("box").alias("field", "vals"))
    field_pool = boxes.select("field", F.explode("vals").alias("v")).distinct()
    field_pool = field_pool.withColumn("n", F.row_number().over(Window.partitionBy("field").orderBy(sha_order(seed, "v"), "v"))).filter("n <= 5000")
    field_pool = field_pool.groupBy(F.col("field").alias("pool_field")).agg(F.sort_array(F.collect_list("v")).alias("pool")).filter(F.size("pool") >= n_options)
    asked_boxes = boxes.withColumn("n", F.row_number().over(Window.partitionBy("title").orderBy(sha_order(seed, "title", "field")))).filter("n <= 2").join(field_pool, F.col("field") == F.col("pool_field"))
    question = F.concat(F.lit("What is the "), F.replace(F.col("field"), F.lit("_"), F.lit(" ")), F.lit(" of "), F.col("title"), F.lit("?"))
    out.append(asked(asked_boxes, "wikibox", question, F.col("lead1"), F.get("vals", F.lit(0)), F.col("vals")))
    rows = out[0]
    for more in out[1:]:
        rows = rows.unionByName(more)
    if caps:
        rows = materialise(rows, "mined")
        limits = rows.select("family").distinct()
        most = F.create_map(*[x for k, v in caps.items() for x in (F.lit(k), F.lit(v))])
        limits = limits.withColumn("most", F.coalesce(F.element_at(most, F.col("family")), F.lit(1 << 62)))
        rows = hash_first(rows, "family", limits, "within", seed, "family", "title", "question").filter("within").drop("within")
    return rows


def seeded_sample(df: DataFrame, n: int, seed: int, *ids: str) -> DataFrame:
    """A uniform sample of ``n`` rows by hash order: what a reservoir gives, on any partitioning."""
    return df.orderBy(sha_order(seed, *ids), *ids).limit(n)
