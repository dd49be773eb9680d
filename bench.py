"""Headline queries at one scale: one warm-up, then the median of three runs each.

Prints one JSON line. BENCH_SF_DIR names the tables, BENCH_CPUS the cores.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from lodestone.plans import registry
from lodestone.session import session

HEADLINE = ["semantic_search", "semantic_search_15", "band_fusion", "similar_sites", "kmeans_assign", "cloud_pct", "erode15", "dehaze", "ssim_box", "hist_match", "invalid_mask", "built_mask", "standardise", "change_events", "monthly_best", "earliest_change", "multiband_pivot", "review_ranked"]
LLM = ["op1_license_scan", "op2_best_fit_packing", "op3_personal_data", "op4_toxicity", "op5_media_columns", "op6_lm_scoring", "op7_mixing", "op8_jaccard_join", "op9_warc", "op10_nearest_neighbours"]


def seconds(run) -> float:
    began = time.perf_counter()
    run()
    return time.perf_counter() - began


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session("bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    queries = {n: (registry.QUERIES[n], 3) for n in HEADLINE}
    try:
        from lodestone.llm import queries as llm

        queries |= {n: (llm.QUERIES[n], 1) for n in LLM}
    except ImportError:
        pass
    took = {}
    for name, (query, runs) in queries.items():
        once = lambda: query(spark, sf_dir).write.format("noop").mode("overwrite").save()  # noqa: B023, E731
        if runs > 1:
            once()
        took[name] = round(statistics.median(seconds(once) for _ in range(runs)), 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cpus": int(cpus)}))


if __name__ == "__main__":
    main()
