"""Runs the headline queries over ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]`` and prints one JSON line."""

from __future__ import annotations

import json
import os
import re
import time

from decisium.plans import registry
from decisium.runtime import release, session

HEADLINE = (
    "m0_gate_family", "norm_n1", "row_key", "validate_errors", "reject_reason", "anti_public", "dedup_first", "dedup_count", "split_fraction", "split_topic_disjoint",
    "rebalance", "content_split_tag", "family_mix", "n_hist_family", "ctx_median", "top_bigrams", "topic_overlap", "census_rollup", "gate_checks", "tokens", "vocab_topk",
    "encode_ids", "accuracy", "ece_fixed", "rank_options", "span_topk", "accept_variator", "orc_merge", "chunks", "stream_append",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session("bench", int(os.environ.get("BENCH_CPUS", "8")))
    spark.sparkContext.setLogLevel("ERROR")
    found = registry.queries()
    found["family_mix"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # starts the workers and compiles
    took = {}
    for name in HEADLINE:
        begun = time.time()
        found[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - begun, 3)
        release(spark)
    scale = re.search(r"sf([\d.]+)", sf_dir)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": float(scale[1]) if scale else None}), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
