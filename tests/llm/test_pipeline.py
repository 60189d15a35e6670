"""The corpus pipeline, stage by stage, against the operators' brute force."""

from __future__ import annotations

import re
from collections import Counter

import corpus_pipeline
from decisium.llm import quality, secret_scan
from decisium.runtime import materialise, table
from test_media_operators import brute_near


def test_stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "minhash_near_dedup", "secret_scans", "source_mixing", "best_fit_packing"]

    kept = materialise(stages["quality_rules"](spark, docs, sf_dir), "t")
    assert kept.columns == columns
    verdict = {r["doc_id"] for r in quality.judge(docs, table(spark, sf_dir, "labels")).collect() if r["kept"]}
    assert {r["doc_id"] for r in kept.collect()} == verdict and len(verdict) > 0.6 * docs.count()

    lone = materialise(stages["minhash_near_dedup"](spark, kept, sf_dir), "t")
    assert lone.columns == columns
    want = brute_near([(r["doc_id"], r["text"]) for r in kept.collect()], 5, 80, 100)
    assert {r["doc_id"] for r in lone.collect()} == {i for i, v in want.items() if v[2]}

    safe = materialise(stages["secret_scans"](spark, lone, sf_dir), "t")
    assert safe.columns == columns and safe.count() == lone.count()
    assert all(not s["spans"] for s in secret_scan.scan(safe, secret_scan.BASE_RULES).collect())

    mixed = materialise(stages["source_mixing"](spark, safe, sf_dir), "t")
    assert mixed.columns == columns
    words = lambda df: sum(len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) for r in df.collect())
    assert abs(words(mixed) - 1.5 * words(safe)) < 0.05 * words(safe)

    packed = stages["best_fit_packing"](spark, mixed, sf_dir).collect()
    assert Counter(r["doc_id"] for r in packed if r["piece"] == 0) == Counter(r["doc_id"] for r in mixed.collect())


def test_empty_table(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        assert docs.count() == 0
        docs = table(spark, sf_dir, "documents").limit(0)


def test_stages_on_odd_rows(spark, sf_dir):
    """Nulls, repeated rows, a very long text and columns with the operators' own names pass through every stage."""
    words = (table(spark, sf_dir, "documents").filter("doc_id = 3").first()["text"] or "").split()
    text = lambda k: " ".join([*words[:60], *(f"w{k}x{j}" for j in range(60))])
    rows = [(i, text(i), None if i % 5 == 0 else f"s{i % 3}") for i in range(30)] + [(7, text(7), "s1")] * 3 + [(None, text(99), "s0"), (None, text(98), None), (40, None, "s0"), (41, "", None), (42, text(42) * 400, "s9")]
    names = "own_row int, w string, size long, row_no int, own int, verdict string, gone_id long, again_id long, start long, copies int"
    df = spark.createDataFrame([(i, t, "en", s, len(t or ""), 1, "w", 2, 3, 4, "v", 5, 6, 7, 8) for i, t, s in rows], f"doc_id long, text string, lang string, source string, n_chars long, {names}")
    docs, kept = df, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), "t")
        assert docs.columns == df.columns, name
        kept.append(Counter(r["doc_id"] for r in docs.select("doc_id").collect()))
    assert kept[0][7] in (0, 4) and kept[1][7] == bool(kept[0][7]) and kept[1][None] == kept[0][None] and kept[2] == kept[1]
    assert all(i not in kept[0] for i in (40, 41))
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert Counter(r["doc_id"] for r in packed if r["piece"] == 0) == kept[3] and len(kept[3]) > 5
