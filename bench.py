"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the data folder, BENCH_CPUS the number of local threads. Every query runs to its
end into Spark's ``noop`` sink; untimed runs of a few queries warm the session up first.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from quizgrove.plans.catalogue import QUERIES  # noqa: E402
from quizgrove.plans.fixtures import table  # noqa: E402
from quizgrove.session import build_session, new_folder  # noqa: E402
from quizgrove.sources import changes  # noqa: E402
from quizgrove.streaming import feeds  # noqa: E402

HEADLINE = (
    "x13_overview_stats", "x4_visible_list", "x6_visibility_check", "x7_edit_permission", "x9_fork_or_overwrite",
    "x11_resolve", "x12_acl_names", "f1_clean_html", "f2_build_text", "f4_truncate", "f5_int64_id", "r1_embed",
    "j13_knn", "r2_search", "t6_same_type_first", "r9_recall", "w1_keep_first", "a16_consistency", "c2_incremental",
    "c10_reconcile", "c11_verify", "c5_cdc_latest", "c5_stream_upsert", "a5_risk_group", "t3_newest",
    "l2_interval_effect", "l9_error_tree", "l15_standard_scores", "l16_score_distribution", "l22_item_analysis",
    "l28_refresh_5_minutes",
)
def change_throughput(spark, sf_dir: str) -> float:
    """Rows a second from the waiting feed into the newest-per-key copy, in batches of up to 100 000 rows."""
    rows = table(spark, sf_dir, "f_change")
    count = rows.count()
    files = max(1, -(-count // 12_500))
    feed, root = new_folder(spark, "bench-feed"), new_folder(spark, "bench-copy")
    rows.repartition(files).write.parquet(feed)
    start = time.perf_counter()
    stream = changes.file_changes(spark, feed, files_per_batch=changes.MAX_ROWS // 12_500)
    work = feeds.upsert_batch(f"{root}/copy", max_bad=count, table="abc_warning")
    feeds.start(stream, work, f"{root}/checkpoint").awaitTermination()
    return round(count / (time.perf_counter() - start), 1)


WARM_UP = ("x12_acl_names", "x13_overview_stats", "f5_int64_id", "j13_knn")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", master=f"local[{cpus}]")
    spark.sparkContext.setLogLevel("ERROR")
    for name in WARM_UP:
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    result = {
        "metric": "total_seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "cdc_rows_per_second": change_throughput(spark, sf_dir),
    }
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main()
