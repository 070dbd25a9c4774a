"""Headline queries, one JSON line. Each is run once, to the last row, through the no-op sink."""

from __future__ import annotations

import json
import os
import time

from emberline.plans.queries import QUERIES
from emberline.session import local_session

HEADLINE = (
    "dly_tokens", "weather_wide", "weather_enriched", "fire_rejects", "fire_polygon_box", "station_pairs", "station_neighbors",
    "cell_station", "interp_monthly", "weather_summary", "fire_events", "cell_fire_table", "cell_stats", "target_cells",
    "training_samples", "baseline_scores", "model_metrics", "pool_summary",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "emberline-bench")
    spark.sparkContext.setLogLevel("ERROR")
    # Start-up of the session is not part of any query.
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds = {}
    for name in HEADLINE:
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    print(
        json.dumps(
            {
                "metric": "headline_total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
