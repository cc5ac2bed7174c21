"""Time the headline queries at one scale factor; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pagerisk.plans import queries  # noqa: E402
from pagerisk.session import build_session  # noqa: E402

# Query and the table whose rows it scans.
HEADLINE = {
    "flagship_fused_metrics": "events", "d1_inner_alignment": "events", "d2_coverage_alignment": "events",
    "e14_metric_table": "events", "e22_duplicate_aggregation": "lineitem", "e23_extended_coverage": "events",
    "k4_two_band_search": "events", "i1_time_group_split": "events", "c2_url_shape": "pages",
    "c2_url_ngram_shares": "pages", "m1_html_features": "pages", "e33_tfidf": "documents",
    "d16_dimension_enrichment": "lineitem", "f9_host_transitions": "events", "j20_auto_flip": "events",
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.enabled": "false", "spark.log.level": "ERROR"},
    )
    registered = queries()
    only = sys.argv[1:] or list(HEADLINE)
    registered[only[0]](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm the JVM
    seconds, rates, sizes = {}, {}, {}
    for name in only:
        start = time.perf_counter()
        registered[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        table = HEADLINE.get(name, "events")
        if table not in sizes:
            sizes[table] = spark.read.parquet(f"{sf_dir}/{table}.parquet").count()
        rates[name] = round(sizes[table] / seconds[name])
    print(json.dumps({
        "metric": "total time of the headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "rows_per_sec": rates, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
