"""Vocabulary, token ids, padding and the embedding bag."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from decisium.functions.hashing import number_bucket
from decisium.functions.text import model_text, tokens

PAD, UNKNOWN, FIRST_NUMBER, NUMBERS = 0, 1, 2, 4096
FIRST_WORD = FIRST_NUMBER + NUMBERS
#: Stands between options while they are normalised together: a private character that no normaliser changes.
BREAK = "\ue000"


def vocabulary(df: DataFrame, texts: list[Column], size: int = 16_384, order: str | None = None) -> DataFrame:
    """(word, n, id): the most frequent tokens of all texts; ties alphabetically, or with ``order`` (a column of unique numbers) by first occurrence."""
    words = F.flatten(F.array(*[tokens(model_text(t)) for t in texts]))
    if order is None:
        every = df.select(F.explode(words).alias("word"))
        ties, first = ["word"], []
    else:  # a row's number and the place in its texts as one number
        every = df.select(F.col(order).alias("own_order"), F.posexplode(words).alias("place", "word"))
        ties, first = ["first"], [F.min(F.col("own_order") * F.lit(1 << 24).cast("long") + F.least("place", F.lit((1 << 24) - 1))).alias("first")]
    top = every.groupBy("word").agg(F.count("*").alias("n"), *first).orderBy(F.col("n").desc(), *ties).limit(size)
    return top.withColumn("id", (F.row_number().over(Window.orderBy(F.col("n").desc(), *ties)) - 1 + FIRST_WORD).cast("long")).select("word", "n", "id")


def lookup(vocab: DataFrame):
    """A function of a text column: array<long> of word ids, else number buckets, else unknown.

    The vocabulary (of a fixed size) becomes a hash table in the plan, a constant array
    of short lists, and each row looks its tokens up where it is: nothing is shuffled.
    """
    words = vocab.select("word", "id", F.xxhash64("word").alias("h")).collect()
    slots = 1 << max(4, (2 * len(words)).bit_length())
    lists: list[list[dict]] = [[] for _ in range(slots)]
    for r in words:
        lists[r["h"] % slots].append({"w": r["word"], "i": r["id"]})
    table = F.from_json(F.lit(json.dumps(lists, separators=(",", ":"))), "array<array<struct<w:string,i:bigint>>>")

    def one(w: Column) -> Column:
        found = F.filter(F.get(table, F.pmod(F.xxhash64(w), F.lit(slots)).cast("int")), lambda e: e["w"] == w)
        number = F.when(w.rlike(r"\A\d+\z"), number_bucket(w, NUMBERS, FIRST_NUMBER))
        return F.coalesce(F.get(found, F.lit(0))["i"], number, F.lit(UNKNOWN).cast("long"))

    def ids(words: Column) -> Column:
        return F.coalesce(F.transform(words, one), F.array().cast("array<bigint>"))

    return ids


def encode(df: DataFrame, key: str, text: str, vocab: DataFrame) -> DataFrame:
    """(key, ids array<long>) of every row."""
    return df.select(key, lookup(vocab)(tokens(model_text(text))).alias("ids"))


def encode_rows(df: DataFrame, vocab: DataFrame, max_context: int = 512, max_len: int = 512, option_cap: int | None = None) -> DataFrame:
    """``df`` with context_ids, question_ids and option_ids, cut to their caps (an option's is ``max_len`` at most).

    Words are found first: normalising may pass through Arrow, which no lambda can hold.
    """
    ids, cap = lookup(vocab), min(max_len, option_cap or max_len)
    joined = F.array_join(F.transform("options", lambda o: F.replace(F.coalesce(o, F.lit("")), F.lit(BREAK), F.lit(" "))), BREAK)
    df = df.withColumn("context_words", tokens(model_text("context"))).withColumn("question_words", tokens(model_text("question"))).withColumn("option_texts", F.split(model_text(joined), BREAK))
    options = F.transform(F.when(F.size("options") > 0, F.col("option_texts")).otherwise(F.array().cast("array<string>")), lambda o: F.slice(ids(tokens(o)), 1, cap))
    return df.withColumns({"context_ids": F.slice(ids(F.col("context_words")), 1, max_context), "question_ids": F.slice(ids(F.col("question_words")), 1, max_len), "option_ids": options}).drop("context_words", "question_words", "option_texts")


def embedding_bag(ids: DataFrame, key: str, table: DataFrame) -> DataFrame:
    """(key, dim, value): the sums of the embeddings (id, vector) of each row's ids."""
    rows = ids.select(key, F.explode("ids").alias("id")).join(table.select(F.col("id").alias("table_id"), "vector"), F.col("id") == F.col("table_id"))
    return rows.select(key, F.posexplode("vector").alias("dim", "value")).groupBy(key, "dim").agg(F.sum("value").alias("value"))
