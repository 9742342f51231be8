"""Times the registered queries: one JSON line on stdout.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8). Each query is
written to the ``noop`` sink, so every row and column is produced, after one untimed
run of the first query that starts the JVM and the Python workers.
"""

from __future__ import annotations

import json
import os
import time

from tallybrook.plans import catalog
from tallybrook.session import build_session
from tallybrook.sources import adapter

HEADLINE = [
    "user_type_minute_counts", "user_type_daily_rollup", "type_hourly_counts",
    "user_30s_counts", "recount_vs_rollup", "enriched_events", "validated_requests",
    "batch_acceptance", "dead_letter_routing", "ema_baseline", "anomalies_daily",
    "throttle_decisions", "throttle_busy_keys", "user_recent_events",
    "recent_events_per_user", "recent_anomalies", "dedup_event_key", "retention_events",
    "outcome_totals", "ingest_rate_1m", "latency_quantiles", "latency_histogram",
    "synthetic_events", "stream_minute_counts", "stream_event_tables", "stream_anomalies",
    "stream_throttle",
]


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false",
        "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    rows = adapter.raw_events(spark, sf_dir).count()
    for warm in ("ema_baseline", "stream_minute_counts"):
        run(catalog.QUERIES[warm](spark, sf_dir))
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        run(catalog.QUERIES[name](spark, sf_dir))
        seconds[name] = round(time.perf_counter() - start, 3)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": total, "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "events": rows,
        "events_per_sec": {k: round(rows / v) for k, v in seconds.items() if v > 0},
    }), flush=True)


if __name__ == "__main__":
    main()
