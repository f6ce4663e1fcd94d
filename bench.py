"""Times headline queries; prints one JSON line.

BENCH_SF_DIR names the data folder, BENCH_CPUS the local cores.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from tidecast.plans.catalog import QUERIES  # noqa: E402
from tidecast.session import build_session  # noqa: E402

HEADLINE = (
    "daily_demand", "product_daily_demand", "dense_demand_per_dc", "features_qty_lags", "full_features_template",
    "features_transformed", "aligned_xy", "pareto_products", "describe_prices", "column_profile",
    "metrics_by_model_split", "lr_sufficient_stats", "lr_fit_predict", "two_week_demand_dc",
    "product_demand_from_mix", "order_quantity_per_product",
    "gbt_recursive", "gbt_per_horizon", "rf_pooled", "feature_importance",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus,
        # Tables of a few hundred kilobytes still use every local core.
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64KB",
        "spark.driver.memory": "12g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["features_qty_lags"](spark, folder).write.format("noop").mode("overwrite").save()  # warm-up

    seconds = {}
    for name in HEADLINE:
        start = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
    print(json.dumps({
        "metric": "headline queries, total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": Path(folder).name.removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
