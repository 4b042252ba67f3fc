"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

from wayflow.plans import catalog

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
NAMES = ("popularity_5min", "popularity_hourly", "speed_filter", "sessionize", "origins", "graph_diffusion", "smoothed_sparse", "kernel_weighted", "sp_chain", "sp_chain_k", "tp_chain", "tp_chain_k", "phase_split", "residual_measure", "trip_residuals", "residual_stats", "residual_hist", "crossweek_std", "gamma_sweep", "psi_chain_errors_k")

if __name__ == "__main__":
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "16g").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{SF}/events.parquet").groupBy("user_id").count().write.format("noop").mode("overwrite").save()  # start-up isn't a query's time
    took = {}
    for name in NAMES:
        began = time.time()
        catalog.queries()[name](spark, SF).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": SF.rsplit("sf", 1)[-1]}))
