"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import re
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from checks import compare, registry  # noqa: E402

HEADLINE = [
    "plan_per_crop_metrics", "plan_sectioned", "R1_topk", "R1_topk_blocks", "R2_retrieve_max", "R3_retrieve_sum_time",
    "R4_retrieve_boosted", "F6_hubness", "F7_late_interaction", "F11_pad", "H2_rrf", "H3_weighted_rrf",
    "H4_article_repair_votes", "H5_article_repair_rrf", "H6_article_precision", "M3_ranking_metrics", "A2_bundle_labels",
    "A3_label_vocab", "A5_ts_alignment", "A5_ts_alignment_ids", "A9_assign_sections", "A10_popularity", "J3_counts",
    "J6_restrict_links", "N1_val_ids", "N3_stratified_split", "N4_split_pairs", "B1_sanitize_boxes", "B4_nms",
    "B8_box_features", "E4_weighted_bundle_vector", "N8_score_pairs",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    registry.load()
    spark = compare.session(cores)
    # Start the JVM's and the Python workers' code paths outside the timings.
    registry.QUERIES["R1_topk"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    names = sys.argv[1:] or HEADLINE
    times = {}
    for name in names:
        start = time.perf_counter()
        registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    match = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": float(match.group(1)) if match else sf_dir,
    }))


if __name__ == "__main__":
    main()
