"""Times headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import shutil
import sys
import tempfile
import time

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)

from pyspark.sql import SparkSession  # noqa: E402

#: Statistics of the scale-up: 150,000 rods at sf0.1, at a length that keeps contacts a rod alike.
RUNS = 2


def main() -> None:
    cpus = os.environ.get("BENCH_CPUS", "8")
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    shared = tempfile.mkdtemp(prefix="bench-")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(2 * int(cpus)))
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", f"file://{shared}")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from rodlake import registry
    from rodlake.operators import network, rods, spatial, stats

    def orders(length: float = 0.024, radius: float = 0.002):
        return rods.derived(spark.read.parquet(f"{folder}/orders.parquet"), "o_orderkey", length, radius)

    def scaled_network():
        """The network of ``segments_final`` with all lengths scaled, so that contacts a rod stay as they are at 1,500 rods."""
        table = spark.read.parquet(f"{folder}/customer.parquet")
        by = (1500 / table.count()) ** (1 / 3)
        df = rods.derived(table, "c_custkey", registry.NL * by, registry.NA * by)
        network.network(df, registry.BOX, registry.AXIS, registry.NLIMIT * by)["segments"].write.format("noop").mode("overwrite").save()

    named = {
        "contacts_150k_rods": lambda: spatial.contacts(orders(), registry.BOX, 0.003).count(),
        "contacts_per_rod_150k": lambda: stats.contacts_summary(orders(), registry.BOX, 0.003).collect(),
        "mutual_angles_150k": lambda: stats.mutual_angles(orders(), registry.BOX, 0.003).collect(),
    }
    for q in ("phi_theta_hist", "cell_mean_direction", "excluded_areas", "segments_final", "density_deposit", "raster_counts"):
        named[q] = lambda q=q: registry.QUERIES[q](spark, folder).write.format("noop").mode("overwrite").save()
    named["network_at_constant_density"] = scaled_network
    took = {}
    for name, run in named.items():
        best = float("inf")
        for _ in range(RUNS):
            began = time.time()
            run()
            best = min(best, time.time() - began)
        took[name] = round(best, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": folder.rstrip("/").rpartition("sf")[2]}))
    spark.stop()
    shutil.rmtree(shared, ignore_errors=True)


if __name__ == "__main__":
    main()
