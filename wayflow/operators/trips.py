"""Cleaning, sessions, origins and phases of trips."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from wayflow.functions.geo import haversine


def valid(pings: DataFrame) -> DataFrame:
    """Pings whose position and time are there; NaN counts as absent."""
    return pings.na.drop(subset=["lat", "lon", "us"])


def speed_filter(pings: DataFrame, least: float = 2.0, by: tuple[str, ...] = ("did",), order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """Pings that move at ``least`` m/s from the ping before, or whose speed is unknown (first, going back in time, or a jump in no time).

    The ping before is that of the same device (and file, if ``by`` names one) in the order of arrival, which need not be that of time.
    """
    rows = valid(pings)
    w = W.partitionBy(*by).orderBy(*order)
    lag = lambda c: F.lag(c).over(w)
    rows = rows.withColumns({"dt": (F.col("us") - lag("us")) / 1e6, "dist": haversine(lag("lat"), lag("lon"), F.col("lat"), F.col("lon"))})
    keep = F.when(F.col("dt") > 0, F.col("dist") / F.col("dt") >= least).when((F.col("dt") == 0) & (F.col("dist") < 1), False).otherwise(True)
    return rows.where(keep).drop("dt", "dist")


def sessionize(pings: DataFrame, gap_seconds: int = 300) -> DataFrame:
    """Trip number within a device: a gap of more than ``gap_seconds`` starts a new one."""
    w = W.partitionBy("did").orderBy("us", "seq")
    new = F.coalesce((F.col("us") - F.lag("us").over(w) > gap_seconds * 1_000_000).cast("long"), F.lit(1))
    return pings.withColumn("trip", F.sum(new).over(w.rowsBetween(W.unboundedPreceding, 0)))


def trip_ids(rows: DataFrame, buckets: int = 4096) -> DataFrame:
    """``rows`` (did, trip) with a dense ``route_id`` from 1 over all devices.

    Offsets come in two levels, by bucket of the device's hash and by device inside it, so no window spans all devices.
    """
    bucket = F.pmod(F.xxhash64("did"), F.lit(buckets))
    trips = rows.groupBy("did").agg(F.max("trip").alias("n")).withColumn("bucket", bucket)
    first = trips.groupBy("bucket").agg(F.sum("n").alias("n")).select("bucket", (F.sum("n").over(W.orderBy("bucket")) - F.col("n")).alias("base"))
    inner = (F.sum("n").over(W.partitionBy("bucket").orderBy("did")) - F.col("n")).alias("inner")
    start = trips.select("bucket", "did", inner).join(F.broadcast(first), "bucket").select("did", (F.col("base") + F.col("inner")).alias("start"))
    return rows.join(start, "did").withColumn("route_id", F.col("start") + F.col("trip")).drop("start")


def long_enough(rows: DataFrame, least: int = 5, by: str = "route_id") -> DataFrame:
    """Rows of trips with ``least`` rows or more."""
    return rows.withColumn("__n", F.count("*").over(W.partitionBy(by))).where(F.col("__n") >= least).drop("__n")


def wide_enough(fixes: DataFrame, least: int = 3) -> DataFrame:
    """Fixes of trips on ``least`` distinct links or more."""
    enough = fixes.groupBy("route_id").agg(F.count_distinct("link_id").alias("n")).where(F.col("n") >= least)
    return fixes.join(enough.select("route_id"), "route_id", "left_semi")


def shard(rows: DataFrame, index: int, shards: int, by: str = "route_id") -> DataFrame:
    """One of ``shards`` parts by the remainder of an id."""
    return rows.where(F.pmod(F.col(by), F.lit(shards)) == index)


def popularity(fixes: DataFrame, slot: F.Column, trip: str = "did") -> DataFrame:
    """Distinct trips for each slot and link."""
    return fixes.groupBy(slot.alias("slot"), "link_id").agg(F.count_distinct(trip).alias("n"))


def first_fixes(fixes: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first fix of each trip in list order."""
    return fixes.groupBy(*key).agg(F.min_by(F.struct(*fixes.columns), F.struct(*order)).alias("f")).select("f.*")


def distinct_path(fixes: DataFrame) -> DataFrame:
    """Links of each trip in the order of their first occurrence: route_id, link_id, pos."""
    first = fixes.groupBy("route_id", "link_id").agg(F.min("fix_idx").alias("fix_idx"))
    return first.select("route_id", "link_id", (F.row_number().over(W.partitionBy("route_id").orderBy("fix_idx")) - 1).alias("pos"))


def phase_split(path: DataFrame, links: DataFrame, all_trips: bool = False) -> DataFrame:
    """Length of the way up to the peak of speed times lanes and down from it, for trips of 3 links or more; ties go to the middle, then to the first.

    ``all_trips`` also gives those that are shorter or have no speed: their peak is the first link.
    """
    n = F.count("*").over(W.partitionBy("route_id"))
    rows = path.join(links.select("link_id", "speed", "lanes"), "link_id", "left").withColumn("score", F.coalesce(F.col("speed") * F.col("lanes"), F.lit(0.0))).withColumn("k", n)
    best = F.max_by("pos", F.struct("score", -F.abs(F.col("pos") - (F.col("k") - 1) / 2), -F.col("pos")))
    out = rows.groupBy("route_id").agg(F.max("k").alias("k"), best.alias("l_up"), F.max("score").alias("top"), F.avg("speed").alias("avg_speed"), F.avg("lanes").alias("avg_lanes"))
    split = (F.col("k") >= 3) & (F.col("top") > 0)
    out = out.withColumn("l_up", F.when(split, F.col("l_up")).otherwise(0)) if all_trips else out.where(split)
    return out.select("route_id", "k", F.col("l_up").cast("int").alias("l_up"), (F.col("k") - 1 - F.col("l_up")).alias("l_down"), "avg_speed", "avg_lanes")


def phase_split_weighted(path: DataFrame, links: DataFrame, pieces: DataFrame) -> DataFrame:
    """``phase_split`` in pieces of links (link_id, pieces; 1 where absent); the peak is where the pieces before its link end."""
    at = path.join(pieces, "link_id", "left").withColumn("pieces", F.coalesce("pieces", F.lit(1)))
    w = W.partitionBy("route_id")
    at = at.withColumns({"before": F.coalesce(F.sum("pieces").over(w.orderBy("pos").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)), "k_pieces": F.sum("pieces").over(w)})
    peak = phase_split(path, links).select("route_id", F.col("l_up").alias("pos"))
    return at.join(peak, ["route_id", "pos"]).select("route_id", F.col("k_pieces").alias("k"), F.col("before").alias("l_up"), (F.col("k_pieces") - 1 - F.col("before")).alias("l_down"))


def binned_means(lengths: DataFrame, bins: int = 20, low: float = 3.0) -> DataFrame:
    """Mean speed and lanes of trips (k, avg_speed, avg_lanes) in equal bins of k from ``low`` to the largest; empty bins have zeros."""
    top = lengths.agg(F.max("k").cast("double").alias("top"))
    width = (F.col("top") - low) / bins
    at = F.coalesce(F.least(F.floor(F.try_divide(F.col("k") - low, width)), F.lit(bins - 1)), F.lit(0)).cast("long")
    found = lengths.where(F.col("k") >= low).crossJoin(F.broadcast(top)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.avg("avg_speed").alias("speed"), F.avg("avg_lanes").alias("lanes"))
    return lengths.sparkSession.range(bins).withColumnRenamed("id", "bin").join(found, "bin", "left").na.fill(0)
