"""Time the headline queries from raw tables. Prints one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the local cores. Shared inputs are built anew for
every query, so each figure is a whole run; one small query before them starts the session.
"""

from __future__ import annotations

import json
import os
import sys
import time

from granary.plans import catalog
from granary.session import build_session

HEADLINE = [
    "outlet_features",
    "region_baseline",
    "alerts_deduplicated",
    "outlet_scores",
    "region_health",
    "supply_gap",
    "monthly_series",
    "smoothing_forecast",
    "forecast_run",
    "nearest_outlet_distance",
    "underused_outlets",
    "service_zones",
    "density_clusters",
    "isolation_forest_scores",
    "ring_scores",
    "policy_comparison",
    "tfidf_weights",
    "retrieve_documents",
    "lift_features",
    "kpi_row",
]


def forget() -> None:
    """Drop the remembered inputs of all query modules."""
    for name, module in list(sys.modules.items()):
        if name.startswith("granary.plans"):
            for value in vars(module).values():
                if hasattr(value, "cache_clear"):
                    value.cache_clear()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    catalog.QUERIES["outlet_health"].plan(spark, sf_dir).collect()
    seconds = {}
    for name in names:
        forget()
        spark.catalog.clearCache()
        start = time.perf_counter()
        catalog.QUERIES[name].plan(spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline queries, total time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        )
    )


if __name__ == "__main__":
    main()
