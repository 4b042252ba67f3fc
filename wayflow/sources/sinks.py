"""Writers: every one is a DataFrame write, in parallel and atomic by Spark's committers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def append_pings(rows: DataFrame, path: str) -> None:
    """Append pings (route_id, time_sec, lat, lon) as zstd Parquet."""
    rows.select("route_id", "time_sec", "lat", "lon").write.mode("append").option("compression", "zstd").parquet(path)


def write_routes(fixes: DataFrame, path: str) -> None:
    """One JSON object a line and trip: {"route": {"route_id": ..., "fixes": [[link, time], ...]}}."""
    fix = F.sort_array(F.collect_list(F.struct("fix_idx", F.array(F.col("link_id").cast("string"), F.col("t").cast("string")).alias("f"))))
    trip = fixes.groupBy("route_id").agg(F.transform(fix, lambda x: x["f"]).alias("fixes"))
    trip.select(F.struct("route_id", "fixes").alias("route")).write.json(path)


def write_matrix(cells: DataFrame, path: str, zone: str = "UTC") -> None:
    """Cells (slot: timestamp or seconds since 1970, link_id, value) partitioned by date, so that a scan of some days reads only those."""
    at = F.col("slot") if dict(cells.dtypes)["slot"].startswith("timestamp") else F.timestamp_seconds("slot")
    cells.withColumn("bin_date", F.to_date(at)).repartition("bin_date").sortWithinPartitions("slot", "link_id").write.partitionBy("bin_date").parquet(path)


def write_vector(v: DataFrame, path: str) -> None:
    """(link_id, v) as JSON lines."""
    v.select("link_id", "v").write.json(path)


def concat_chunks(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All objects of chunk files with one object a line; a broken line is an error that names its file.  Files ``*.partial.json`` are left out."""
    from wayflow.sources.lines import json_lines

    rows = json_lines(spark, path, schema, files=True).where(~F.col("file").endswith(".partial.json"))
    broken = F.raise_error(F.concat(F.lit("broken chunk: "), F.col("file")))
    return rows.select(F.when(F.col("good"), F.col("row")).otherwise(broken).alias("row")).select("row.*")


def write_record(rows: DataFrame, path: str) -> None:
    """An experiment's rows as one JSON file: reports are small."""
    rows.coalesce(1).write.json(path)
