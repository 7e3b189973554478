"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tonegap.plans import QUERIES  # noqa: E402
from tonegap.session import build_session  # noqa: E402

HEADLINE = (
    "preprocess_caption gate_feed gate_local gate_embed gate_counters is_sarcasm_candidate "
    "extract_hashtags expand_terms bootstrap_merge prune_pool image_urls caption_from_html "
    "majority_label latest_annotation canonical_join_pool cohens_kappa agreement_report "
    "build_features predict_table review_table stratified_folds confusion dsem_rule claims_table "
    "stage_timing_summary word_heatmap rollout cls_scores read_labelled validate_records "
    "read_checkpoint line_numbers upsert_vectors run_stage features_one_pass cross_validate"
).split()


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "12g",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("OFF")
    spark.read.parquet(f"{sf}/documents.parquet").selectExpr("sum(length(text))").collect()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name].build(spark, sf).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    line = {
        "metric": "headline queries, wall clock",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(line))


if __name__ == "__main__":
    main()
