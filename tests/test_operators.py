"""Operators against plain Python: texts, validation, splits, sources, replies, generators, streams."""

from __future__ import annotations

import hashlib
import json
import os
import random
import re
import unicodedata
from collections import Counter, defaultdict
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from decisium import runtime
from decisium.functions import arrays as A
from decisium.functions import hashing as H
from decisium.functions import text as T
from decisium.functions import wiki
from decisium.operators import audit, encode, merge, metrics, mining, replies, validate
from decisium.sources import generators, jsonl, paged, records
from decisium.streaming import incremental

TEXTS = [
    "", " ", "Hello  World. It's   fine!  Yes", "café ½ Ⅷ naïve", "a b c", "tab\tnew\nline", "ﬁne ＡＢ", "x_y 12 3.5", "don't 'quote'",
    "One. Two? Three! Four", "\x1csep\x85", "UPPER É", "é combining", "1999", "emoji \U0001f600!",
]


def column(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, t {kind}")
    return [r["x"] for r in df.select("i", expr.alias("x")).orderBy("i").collect()]


def test_normalisers(spark):
    squeeze = lambda s: " ".join(re.sub(r"\s+", " ", s).strip(" ").split(" ")) if s.strip() else ""
    assert column(spark, TEXTS, T.collapsed("t")) == [squeeze(t) for t in TEXTS]
    assert column(spark, TEXTS, T.normal("t")) == [squeeze(t).lower() for t in TEXTS]
    assert column(spark, TEXTS, T.model_text("t")) == [squeeze(unicodedata.normalize("NFKC", t)).lower() for t in TEXTS]
    assert column(spark, TEXTS, T.stripped("t")) == [t.strip() for t in TEXTS]
    assert column(spark, [None], T.normal("t")) == [""]


def test_tokens_and_sentences(spark):
    assert column(spark, TEXTS, T.tokens("t")) == [re.findall(r"[^\W_]+(?:'[^\W_]+)?|[^\s]", t) for t in TEXTS]
    assert column(spark, TEXTS, T.word_count("t")) == [len(t.split()) for t in TEXTS]
    assert column(spark, ["A b. C d? E! F", "no end", ""], T.sentences("t")) == [["A b.", "C d?", "E!", "F"], ["no end"], []]


def test_replies_are_parsed(spark):
    cases = {"3": 3, "9) x": None, "(B) because": 1, "h": 7, "": None, "Z": None, "10": None, "  2.": 2, "99999999999999999999 a": None, "answer: c": 0}
    assert column(spark, list(cases), T.parsed_choice("t", F.lit(8))) == list(cases.values())
    assert column(spark, ["x [1, 2] y", "none", "a [b] c [d] e"], T.json_array_text("t")) == ["[1, 2]", None, "[b] c [d]"]


def test_similarity_is_the_standard_ratio(spark):
    rng = random.Random(1)
    pairs = [("abc", "abd"), ("", ""), ("same", "same")] + [("".join(rng.choices("abc ", k=30)), "".join(rng.choices("abc ", k=250))) for _ in range(20)]
    df = spark.createDataFrame(pairs, "a string, b string")
    for r in df.withColumn("x", T.similarity("a", "b")).collect():
        assert r["x"] == SequenceMatcher(None, " ".join(r["a"].split()), " ".join(r["b"].split())).ratio()


def test_hashes(spark):
    import hashlib

    keys = ["abc", "", "é", "x" * 1000]
    assert column(spark, keys, H.sha_mod(F.col("t"))) == [int(hashlib.sha256(k.encode()).hexdigest(), 16) % 1000 for k in keys]
    numbers = ["0", "12", "99999999999999999999999", "4095", "4096"]
    assert column(spark, numbers, H.number_bucket(F.col("t"))) == [int(n) % 4096 + 2 for n in numbers]
    m = (5, 11, 200_000)
    for text, got in zip(keys[:3], column(spark, keys[:3], H.ngram_hashes(H.byte_values(F.col("t")), m, 1 << 18)), strict=True):
        b = text.encode()
        assert got == [sum((b[i + j] + 1) * m[j] for j in range(3)) % (1 << 18) for i in range(len(b) - 2)]


def chunk_by_loop(text):
    out, now, n = [], [], 0
    for s in (s for s in re.split(r"(?<=[.!?])\s+", " ".join(text.split())) if len(s) >= 40):
        if now and (n + len(s) > 700 or len(now) >= 4):
            out.append(" ".join(now))
            now, n = [], 0
        now.append(s)
        n += len(s)
    if now:
        out.append(" ".join(now))
    return [c for c in out if 180 <= len(c) <= 704 and not re.search(r"\{\{|\}\}|\[\[|\]\]|<|>", c)]


def test_chunks(spark):
    rng = random.Random(2)
    texts = [" ".join("".join(rng.choices("abc ", k=rng.randrange(5, 320))).strip() + rng.choice(".!?") for _ in range(rng.randrange(1, 20))) for _ in range(60)] + ["", "short."]
    assert column(spark, texts, wiki.chunks("t")) == [chunk_by_loop(t) for t in texts]


def test_markup(spark):
    text = "{{a|{{b}}}}Text[[File:x.png|thumb]] of [[Paris|the city]] and [[Rome]].<ref name=x>no</ref><!-- c --> ''It'' [1] is.\n== H ==\n[[Category:Old towns|key]] [[Category:All stubs]]"
    assert column(spark, [text], wiki.clean_markup("t"))[0].startswith("Textthumb of the city and Rome. It is.")
    assert column(spark, [text], wiki.categories("t"))[0] == ["Old towns"]
    assert column(spark, [text], wiki.link_labels("t"))[0] == ["the city"]
    assert wiki.balanced("x{{a{{b}}c}}y{{z") == [(1, 12)] and wiki.balanced("}}{{a}}") == [(2, 7)]
    assert column(spark, ["x{{a{{b}}c}}y{{z", None], wiki.without_templates("t")) == ["x y{{z", ""]
    assert wiki.split_outside("a|{{b|c}}|[[d|e]]|f") == ["a", "{{b|c}}", "LINK", "f"]
    box = "{{Infobox town\n| capital = [[A|B]]\n| founded_year = 1200<!-- x -->\n| unknown = 3\n| population = 5 {{small|x}}\n}}"
    assert column(spark, [box, ""], wiki.infobox("t")) == [{"capital": ["LINK"], "founded": ["1200"], "population": ["5 x"]}, {}]


def test_facts(spark):
    cases = {
        "The old bridge was opened to all traffic in 1887 by the mayor.": ("year", "1887"),
        "The town is located in Bavaria, close to the river.": ("place", "Bavaria"),
        "The lake holds 1,200 boats in summer.": ("number", "1,200"),
        "The abbey was founded by Hildegard Stone, a nun.": ("who", "Hildegard Stone"),
        "A zither is a kind of string instrument": ("cat", "string instrument"),
        "Nothing to see here at all.": None,
    }
    got = column(spark, list(cases), wiki.facts("t"))
    assert [tuple(g) if g else None for g in got] == list(cases.values())


def canonical(**change):
    row = {"context": "c", "question": "q?", "options": ["a", "b", "c"], "correct_index": 1, "meta": {"family": "retrieval"}}
    row.update(change)
    return json.dumps(row)


def test_validation_rules(spark):
    bad = {
        canonical(context=3): "context is not a string", canonical(question="  "): "question is blank", canonical(options=["a"]): "options are not 2 to 8; correct_index is out of range",
        canonical(options=list("abcdefghi")): "options are not 2 to 8", canonical(options=["a", " "]): "an option is blank", canonical(options="ab"): "options are not 2 to 8; correct_index is out of range",
        canonical(correct_index=-1): "correct_index is out of range", canonical(correct_index=3): "correct_index is out of range", canonical(correct_index=True): "correct_index is out of range",
        canonical(correct_index="0"): "correct_index is out of range", canonical(teacher_probs=[0.5, 0.5]): "teacher_probs have another length", canonical(teacher_probs=[0, 0, 0]): "teacher_probs don't add up",
        canonical(meta={"family": "sciq"}): "a fact row names no source", canonical(options=["a", 3]): "an option is blank", canonical(options=None): "options are not 2 to 8; correct_index is out of range", "not json": None,
    }
    rows = validate.validate_json(spark.createDataFrame([(i, v) for i, v in enumerate(bad)], "i int, value string")).orderBy("i").collect()
    for (text, want), r in zip(bad.items(), rows, strict=True):
        assert r["row"] is None and (want is None or r["errors"] == want), (text, r["errors"])
    good = [canonical(), canonical(correct_index=None, context=""), canonical(teacher_probs=[1, 2, 1]), canonical(meta={"family": "sciq", "source": "x"}), canonical(meta={"family": "strange", "tier": "fact", "dataset": "d"})]
    rows = validate.validate_json(spark.createDataFrame([(i, v) for i, v in enumerate(good)], "i int, value string")).orderBy("i").collect()
    assert all(r["errors"] is None for r in rows)
    assert rows[0]["row"]["teacher_probs"] == pytest.approx([0.025, 0.95, 0.025]) and rows[1]["row"]["teacher_probs"] == pytest.approx([1 / 3] * 3)
    assert rows[2]["row"]["teacher_probs"] == [0.25, 0.5, 0.25] and rows[0]["row"]["label_source"]["vote"] == "direct"
    assert rows[4]["row"]["task"] == "unknown" and rows[4]["row"]["meta"]["family"] == "strange"


def test_na_padding(spark):
    cases = {"n/a": True, "None": True, "": True, " ": True, "Na": False, "na": True, "NA": True, "sodium": False, None: True}
    assert column(spark, list(cases), validate.na_padding("t")) == list(cases.values())


def test_option_cleaning_moves_the_gold(spark):
    df = spark.createDataFrame([(["x", "X ", "", "y"], 3), (["x", " x", "y"], 1), (["", "a"], 0)], "o array<string>, g int")
    got = [(r["c"]["options"], r["c"]["gold"]) for r in df.select(A.clean_options("o", "g").alias("c")).collect()]
    assert got == [(["x", "y"], 1), (["x", "y"], 0), (["a"], None)]


def split_frame(spark, n=600, parts=3):
    rng = random.Random(5)
    rows = [(f"r{i}", i, f"f{rng.randrange(4)}", rng.choice([None, "t1", "t2", "t3", "t4", "t5", "t6"]), rng.choice([None, None, "train", "eval"])) for i in range(n)] + [("lone", n, "single", None, None)]
    return spark.createDataFrame(rows, "id string, seq long, family string, topic string, side string").repartition(parts)


@pytest.mark.parametrize("split", [lambda d: merge.split_by_fraction(d, 0.1), lambda d: merge.split_by_topic(d, 0.2), lambda d: merge.split_forced(d, "side", lambda f: merge.split_by_topic(f, 0.2))])
def test_splits_partition_the_rows(spark, split):
    one, other = ({r["id"]: r["is_eval"] for r in split(split_frame(spark, parts=p)).collect()} for p in (1, 7))
    assert one == other and len(one) == 601 and one["lone"]


def test_topics_stay_on_one_side(spark):
    side = defaultdict(set)
    for r in merge.split_by_topic(split_frame(spark), 0.2).collect():
        if r["topic"]:
            side[r["family"], r["topic"]].add(r["is_eval"])
    assert all(len(s) == 1 for s in side.values()) and {True, False} <= {x for s in side.values() for x in s}


def test_rebalance_fills_eval(spark):
    df = split_frame(spark).withColumn("split", F.when(F.col("seq") % 50 == 0, "eval").otherwise("train"))
    out = merge.rebalance(df, 0.09)
    for r in audit.eval_fractions(out).collect():
        assert not r["low"]
    assert out.count() == df.count()


def test_dedup_is_first_and_idempotent(spark):
    df = spark.createDataFrame([(i, f"k{i % 7}") for i in range(100)], "seq long, key string").repartition(5)
    once = merge.first_per_key(df, "key")
    assert sorted(r["seq"] for r in once.collect()) == list(range(7))
    assert merge.first_per_key(once, "key").count() == 7
    with pytest.raises(ValueError):
        merge.require_no_leak(df, df.limit(1), "key")


def test_metric_edges(spark):
    rows = [([1.0, 0.0], 0), ([0.5, 0.5], 1), ([0.1, 0.9], 1), ([0.3, 0.7], None)]
    df = spark.createDataFrame(rows, "probs array<double>, correct_index int")
    r = metrics.scores(df).first()
    assert r["n"] == 3 and r["accuracy"] == pytest.approx(2 / 3) and r["brier"] == pytest.approx((0 + 0.5 + 0.02) / 3)
    assert {x["bin"]: x["n"] for x in metrics.calibration(df).collect()} == {9: 2, 5: 1}
    same = spark.createDataFrame([([0.5, 0.5], 0)] * 3, "probs array<double>, correct_index int")
    assert metrics.ece_between(same).first()["ece"] == 0.0
    stop = spark.createDataFrame(list(enumerate([5.0, 4.0, 4.5, 4.1, 4.2, 3.0])), "epoch long, loss double")
    assert [x["stopped"] for x in metrics.early_stop(stop).orderBy("epoch").collect()] == [False, False, False, False, True, True]
    assert column(spark, [[1.0, 2.0, 3.0]], A.softmax("t", F.array(F.lit(True), F.lit(False), F.lit(True))), "array<double>")[0][1] == 0.0


def test_encoding(spark):
    df = spark.createDataFrame([(1, "b a b"), (2, "77 unknown!"), (3, "")], "k int, t string")
    vocab = encode.vocabulary(df.filter("k = 1"), [F.col("t")])
    assert [(r["word"], r["id"]) for r in vocab.orderBy("id").collect()] == [("b", 4098), ("a", 4099)]
    got = {r["k"]: r["ids"] for r in encode.encode(df, "k", "t", vocab).collect()}
    assert got == {1: [4098, 4099, 4098], 2: [79, 1, 1], 3: []}


def test_json_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("\n".join([canonical(), "", canonical(correct_index=9), "{broken", canonical(question="z")]))
    valid, rejected = jsonl.read_rows(spark, str(tmp_path / "a.jsonl"), strict=False)
    assert sorted(r["line"] for r in valid.collect()) == [1, 5] and sorted(r["line"] for r in rejected.collect()) == [3, 4]
    with pytest.raises(Exception, match="a.jsonl:[34]"):
        jsonl.read_rows(spark, str(tmp_path / "a.jsonl"))[0].collect()
    good, bad = jsonl.read_tolerant(spark, str(tmp_path / "a.jsonl"), "question string")
    assert good.count() == 3 and bad.count() == 1
    counts = {r["family"]: r["n"] for r in jsonl.finished_counts(spark, str(tmp_path / "a.jsonl"), ["retrieval", "sets"]).collect()}
    assert counts == {"retrieval": 3, "sets": 0}
    status = jsonl.write_status(jsonl.finished_counts(spark, str(tmp_path / "a.jsonl"), ["retrieval"]), str(tmp_path / "s.json"), 2)
    assert status == json.loads((tmp_path / "s.json").read_text()) == {"retrieval": 2}


def test_pages_and_headlines(spark, tmp_path):
    pages = [{"title": "A long one", "text": "x" * 100}, {"title": "R", "text": "x" * 100, "redirect_target": "A"}, {"title": "Short", "text": "x"}, {"title": "ab", "text": "y" * 90}]
    (tmp_path / "p.jsonl").write_text("\n".join(map(json.dumps, pages)))
    assert [r["title"] for r in jsonl.read_pages(spark, str(tmp_path / "p.jsonl")).collect()] == ["A long one", "ab"]
    assert [r["title"] for r in jsonl.read_pages(spark, str(tmp_path / "p.jsonl"), tolerant=True).collect()] == ["A long one"]
    assert jsonl.read_pages(spark, str(tmp_path / "p.jsonl"), max_scan=1).count() == 1
    assert [r["title"] for r in jsonl.headlines(spark, str(tmp_path / "p.jsonl"), 3).collect()] == ["A long one", "Short"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, family string")
    assert jsonl.append_new(df, str(tmp_path / "o"), "k") == 2
    assert jsonl.append_new(df.union(spark.createDataFrame([(3, "c")], df.schema)), str(tmp_path / "o"), "k") == 1
    assert spark.read.json(str(tmp_path / "o")).count() == 3
    jsonl.write_by_family(df, str(tmp_path / "f"))
    assert (tmp_path / "f" / "family=a").exists()


def test_paged_source_and_cache(spark, tmp_path):
    for at in (0, 100):
        (tmp_path / f"{at}.json").write_text(json.dumps([{"question": f"q{at + i}", "choices": ["a", "b"], "answer": 1} for i in range(100 if not at else 30)]))
    spark.dataSource.register(paged.PagedSource)
    df = spark.read.format("paged_rows").option("pages", str(tmp_path)).option("max_rows", 300).load()
    assert df.count() == 130 and spark.read.format("paged_rows").option("pages", str(tmp_path)).option("max_rows", 50).load().count() == 50
    rows = records.canonical(records.accepted(records.decode(df, "mmlu"), 120), "mmlu")
    assert rows.count() == 120
    calls = []

    def fetch():
        calls.append(1)
        return records.halves(rows, "mmlu", "salt").withColumn("pub_set", F.lit("mmlu"))

    for _ in range(2):
        cached = paged.cached(spark, str(tmp_path / "cache"), fetch)
    assert len(calls) == 1 and cached.count() == 120
    half = paged.half_counts(cached).first()
    assert half["train_half"] + half["eval_half"] == 120 and min(half["train_half"], half["eval_half"]) > 30


def test_quotas(spark):
    df = spark.createDataFrame([(str(i), f"s{i % 3}") for i in range(90)], "id string, subject string")
    out = records.balanced_sample(df, "subject", 10, 25).collect()
    assert len(out) == 25 and max(Counter(r["subject"] for r in out).values()) <= 10


@pytest.mark.parametrize("name", sorted(generators.FAMILIES))
def test_generated_rows(spark, name):
    rows = generators.rows(spark, name, 60).collect()
    assert len(rows) == 60
    for r in rows:
        assert len(r["options"]) == len(set(r["options"])) == 8, (name, r)
        assert sum(r["teacher_probs"]) == pytest.approx(1)
        assert (r["correct_index"] is None) == (name == "ambiguity")
        gold = r["options"][r["correct_index"]] if r["correct_index"] is not None else None
        n = [int(x) for x in re.findall(r"\d+", r["question"])]
        if name == "arithmetic":
            a, b = n
            q = r["question"]
            want = a + b if "plus" in q else a - b if "minus" in q else a * b if "times" in q else (a + b) // 2 if "mean" in q else a * b // 100
            assert gold == str(want)
        if name == "numeric":
            x = [int(v) for v in re.findall(r"\d+", r["context"])]
            assert gold == str(sum(x) if "add" in r["question"] else max(x) - min(x) if "exceed" in r["question"] else max(x))
        if name == "conditional":
            limit, load = (int(v) for v in re.findall(r"\d+", r["context"]))
            assert ("boat" in gold) == (load > limit)
        if name == "sequence_next" and n[1] - n[0] == n[2] - n[1] == n[3] - n[2]:
            assert gold == str(n[3] + n[1] - n[0])
        if name == "timeclock":
            h, m = map(int, re.findall(r"\d+", r["context"]))
            t = (h * 60 + m + n[0]) % 1440
            assert gold == f"{t // 60:02d}:{t % 60:02d}"
        if name == "counting":
            assert gold == str(r["context"].count(re.search("the (.*) named", r["question"])[1]))
        if name == "compare":
            ages = {p: int(a) for p, a in re.findall(r"(\w+) is (\d+)", r["context"])}
            assert ages[gold] == (max if "oldest" in r["question"] else min)(ages.values())
    assert [r["id"] for r in generators.rows(spark, name, 60).repartition(3).orderBy("row_no").collect()] == [r["id"] for r in sorted(rows, key=lambda r: r["row_no"])]


def test_chain_rows_are_verified(spark):
    for name in generators.CHAINS:
        df = generators.chain_seeds(spark, name, 50)
        text = generators.seed_line(name, F.col("seed"))
        good = df.select(generators.verified(name, text, F.col("expected"), F.col("seed")).alias("v"))
        bad = df.select(generators.verified(name, text, F.lit("nothing"), F.col("seed")).alias("v"))
        assert all(r["v"] for r in good.collect()) and not any(r["v"] for r in bad.collect())


def test_noise(spark):
    rows = generators.rows(spark, "retrieval", 40)
    out = generators.noised(rows).collect()
    assert out and all(1 <= r["noise_injected"] <= 3 and r["id"] != r["source_id"] for r in out)
    none = rows.withColumn("options", F.array(F.lit("the"), F.lit("a"), F.lit("had"), F.lit("by")))
    assert generators.noised(none).count() == 0


def test_mined_rows(spark):
    text = "{{Infobox x\n| capital = C%d\n| currency = M%d\n}}\nTown %d is a quiet old place that people visit for its many markets. More [[T%d|label %d]] here.\n[[Category:Kind %d]]"
    pages = spark.createDataFrame([(f"Town {i}", i, None, text % (i, i, i, i, i, i)) for i in range(30)], "title string, seq long, redirect_target string, text string")
    seeds = mining.seeds(pages).persist()
    assert seeds.count() == 30
    rows = mining.mined_rows(seeds).collect()
    assert Counter(r["family"] for r in rows) == {"define": 30, "knowledge": 30, "wikicat": 30, "wikiret": 30, "wikibox": 60}
    for r in rows:
        assert len({o.lower() for o in r["options"]}) == 8
    assert max(Counter(r["family"] for r in mining.mined_rows(seeds, caps={"define": 5, "wikibox": 7}).collect()).values()) == 30
    assert mining.mined_rows(seeds.limit(3)).count() == 0  # pools are too small for eight options


def test_reply_shapes(spark):
    shapes = ['{"choices":[{"message":{"content":"hi"}}]}', '{"data":{"choices":[{"message":{"content":"hi"}}]}}', '{"choices":[{"message":{"content":[{"text":"h"},{"text":"i"}]}}]}', '{"choices":[{"message":{"content":"","reasoning":"hi"}}]}', "hi"]
    assert column(spark, shapes, replies.reply_text(F.col("t"))) == ["hi"] * 5


def test_streams_equal_batches(spark, tmp_path):
    df = spark.createDataFrame([(i, i % 13, f"f{i % 3}") for i in range(300)], "seq long, key long, family string").repartition(6)
    df.write.parquet(str(tmp_path / "in"))
    stream = lambda: incremental.read_new_files(spark, str(tmp_path / "in"), df.schema)
    incremental.append_once(stream(), str(tmp_path / "out"), str(tmp_path / "s1")).awaitTermination()
    incremental.append_once(stream(), str(tmp_path / "out"), str(tmp_path / "s1")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 300
    incremental.to_table(incremental.without_repeats(stream(), "key"), "t_dedup", "append", str(tmp_path / "s2")).awaitTermination()
    assert spark.table("t_dedup").count() == 13
    incremental.to_table(incremental.progress(stream()), "t_progress", "complete", str(tmp_path / "s3")).awaitTermination()
    assert {r["family"]: r["n"] for r in spark.table("t_progress").collect()} == {"f0": 100, "f1": 100, "f2": 100}


def test_report(spark):
    df = spark.createDataFrame([("a", 1), ("b", None)], "family string, n int")
    assert audit.markdown(df).splitlines()[-1] == "| b |  |"


def test_hash_first_equals_whole_sorts(spark):
    """Counted prefixes give what sorting every group gives, for limits below, at and above a group's size, null groups too."""
    rng = random.Random(8)
    rows = [(i, rng.choice(["a", "b", "c", None])) for i in range(3000)]
    most = {"a": 0, "b": 333, "c": 10**6, None: 7}
    df, limits = spark.createDataFrame(rows, "id long, g string"), spark.createDataFrame(list(most.items()), "g string, most long")
    sha = lambda g, i: hashlib.sha256("|".join(x for x in ("7", g, str(i)) if x is not None).encode()).hexdigest()
    want = set()
    for g, n in most.items():
        want |= set(sorted((i for i, h in rows if h == g), key=lambda i: (sha(g, i), i))[:n])
    got = merge.hash_first(df, "g", limits, "flag", 7, "g", "id").collect()
    assert len(got) == 3000 and {r["id"] for r in got if r["flag"]} == want


def test_line_numbers_of_split_files(spark, tmp_path):
    lines = [["" if i % 7 == 0 else f"line {i} {'x' * (i % 50)}" for i in range(1, 4001)], ["one", "", "three"]]
    for k, own in enumerate(lines):
        (tmp_path / f"f{k}.jsonl").write_text("\n".join(own) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        got = sorted((r["path"][-7], r["line"], r["value"]) for r in jsonl.read_numbered(spark, str(tmp_path)).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == [(str(k), i, x) for k, own in enumerate(lines) for i, x in enumerate(own, 1) if x]


def test_census_report(spark):
    df = spark.createDataFrame(
        [("r1", "f", "t", "train", 1), ("r2", "f", "t", "eval", 2), ("r3", "f", None, "train", 3), ("r4", "g", "u", "train", 4)], "id string, family string, topic string, split string, seq long"
    ).withColumns({"question": F.lit("q?"), "options": F.array(F.lit("a"), F.lit("b")), "correct_index": F.lit(1), "probs": F.array(F.lit(0.1), F.lit(0.9)), "context": F.lit("c"), "tier": F.lit("shape"), "generated_by": F.lit("x")})
    report = audit.census_report(df, F.when(F.col("family") == "f", "made").otherwise("mined")).split("\n")
    assert "- train: 3 rows" in report and "| f | made | 2 | 66.67% | 1 | 100.00% |" in report and "| mined | 1 | 33.33% | 0 | 0.00% |" in report
    assert "    correct: idx=1 → b (gold=0.90)" in report and "| (none) | 1 | 0 |" in report and "| t | 1 | 1 |" in report


def test_example_rows_round_to_even_and_may_lack_a_gold(spark):
    cases = [(None, 0.5), (1, None), (1, 0.125), (1, 0.375), (1, 0.145), (1, 0.0), (1, 1.0)]
    df = spark.createDataFrame([(i, g, [0.0, p]) for i, (g, p) in enumerate(cases)], "i int, correct_index int, probs array<double>")
    df = df.withColumns({"question": F.lit("q?"), "options": F.array(F.lit("a"), F.lit("b")), "context": F.lit("c"), "tier": F.lit("shape"), "generated_by": F.lit("x")})
    got = [r["shown"].split("\n")[2] for r in df.select("i", audit.example_row().alias("shown")).orderBy("i").collect()]
    want = [("None", "?", "?") if g is None else (g, "b", "?" if p is None else f"{p:.2f}") for g, p in cases]
    assert got == [f"    correct: idx={g} → {option} (gold={share})" for g, option, share in want]


def test_supervision_gives_up(spark):
    counts = lambda: spark.createDataFrame([("f", 1)], "family string, n long")
    waits = []
    with pytest.raises(KeyError):
        replies.supervise(lambda missing: {}["lost"], counts, 2, most_restarts=3, sleep=waits.append)
    assert waits == [20.0] * 3 and replies.supervise(None, counts, 1) == 0


def test_rounds_wait_longer_each_time(spark):
    waits = []
    requests = spark.createDataFrame([(1,), (2,)], "request_id long")
    call = lambda pending, k: pending.select("request_id", F.when(F.col("request_id") == 1, 200).otherwise(500).alias("status"), F.lit("x").alias("reply"))
    out = {r["request_id"]: (r["status"], r["tries"]) for r in replies.answered(requests, call, tries=4, sleep=waits.append).collect()}
    assert out == {1: (200, 1), 2: (500, 4)} and waits == [2.0, 4.0, 8.0]


def test_written_tables_are_released(spark):
    df = runtime.materialise(spark.range(5), "t")
    path = df.inputFiles()[0].removeprefix("file://")
    n, each = runtime.latency(df)
    assert n == 5 and each > 0 and os.path.exists(path)
    assert runtime.release(spark) >= 1 and not os.path.exists(path) and runtime.release(spark) == 0


def test_numbers_within_keys_over_ranges(spark):
    """A key of most rows, others and null over many small ranges."""
    rng = random.Random(9)
    rows = [(rng.choice(["hot"] * 8 + ["a", "z", None]), i) for i in range(4000)]
    df = spark.createDataFrame(rows, "id string, seq long")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r["seq"]: (r["id"], r["n"]) for r in merge.numbered(df, "id", "seq", "n").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    seen = Counter()
    for k, i in rows:
        seen[k] += 1
        if k is not None:
            assert got[i] == (k, seen[k])
    assert merge.numbered(df.limit(0), "id", "seq", "n").count() == 0
