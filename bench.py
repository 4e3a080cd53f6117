"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query's whole plan is executed with the ``noop`` sink (every row is
produced, nothing is collected to the driver). Prints ONE JSON line:
{"metric": "total_query_seconds", "value": N, "unit": "sec", "queries": {...}, "sf": ...}
"""

from __future__ import annotations

import json
import os
import re
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ledgerline.plans import registry  # noqa: E402
from ledgerline.session import get_spark  # noqa: E402

HEADLINE = [
    "yearly_report", "monthly_summary", "daily_summary", "breakdown_branch", "totals", "day_summary",
    "basket_quote", "top_products", "sales_lines", "count_distinct",
    "recipe_cost", "ingredient_consumption", "join_bom",
    "resolve_periods", "period_report", "join_period", "batch_answers",
    "check_unique", "check_foreign_keys", "check_date_coverage", "update_correlated", "upsert_by_key",
    "chunk_records", "vector_top_k", "text_top_k", "index_upsert",
    "resolve_names", "guarded_select", "fixed_mix_shuffle", "weighted_sample_distinct",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = [a for a in sys.argv[1:]]
    scratch = tempfile.mkdtemp(prefix="bench-")
    spark = get_spark(f"local[{cpus}]", int(cpus) * 2, extra={
        "spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g"),
        "spark.local.dir": scratch,
    })
    queries = registry.all_queries()
    names = only or HEADLINE
    # warm-up (JVM, code generation) on the smallest test folder; not timed,
    # and nothing is cached, so the timed runs read their own data cold
    warm_dir = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    if not os.path.isdir(warm_dir):
        warm_dir = sf_dir
    for name in ("date_range", "yearly_report", "chunk_records"):
        queries[name](spark, warm_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        t0 = time.time()
        df = queries[name](spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
        print(f"{name}: {times[name]}s", file=sys.stderr)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
           "queries": times, "sf": float(m.group(1)) if m else sf_dir}
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
