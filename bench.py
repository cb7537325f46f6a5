"""Wall time of the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default: all cores) and
BENCH_QUERIES (comma-separated names) choose what is run.
"""

from __future__ import annotations

import json
import os
import time

from gridpanel.session import build_session
from suite import load

HEADLINE = (
    "recovery", "stable_entities", "trend_forecast", "build_final", "resolve_mean", "table_summary", "null_profile",
    "entity_profile", "melt_hosts_rows", "era_early", "species_state", "relocation_events", "anomaly_features",
    "harvest_features", "lag_regression_features", "entity_features", "stability_threshold", "temporal_folds",
    "percentile_cut", "order_search_ar", "forecast_backtest", "forecast_future", "isolation_scores", "silhouette",
    "logit_balanced",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    spark = build_session(
        "bench", master=f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "16g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = load().QUERIES
    # start the JVM's and the Python workers' code paths outside the measurement
    queries["yearly_sum"](spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    total = round(sum(seconds.values()), 3)
    sf = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": seconds, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
