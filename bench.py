"""Times the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from tributary import plans
from tributary.session import session

HEADLINES = [
    "q_min_top_pairs", "q_a01_flow_aggregate", "q_a09_undirected", "q_j03_reciprocal_pairs", "q_j08_top_payees", "q_a11_histogram", "q_w02_series_7d",
    "q_t01_account_volumes", "q_g01_rings_hop", "q_g05_pagerank", "q_g15_triangles", "q_g17_neighbour_degrees", "q_g12_conductance", "q_f01_feature_base",
    "q_l01_latest", "q_a21_confusion", "q_m04_metrics", "q_p13_transactions",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = session(f"local[{cpus}]", cpus)
    spark.sparkContext.setLogLevel("ERROR")
    queries = plans.queries()
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()  # the session starts before the clock does
    took = {}
    for name in HEADLINES:
        began = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "seconds for all headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
