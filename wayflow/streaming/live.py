"""Streams of pings and fixes: the same transformations run on a batch, where watermarks have no effect."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def popularity(fixes: DataFrame, late: str = "10 minutes", slot: str = "5 minutes") -> DataFrame:
    """(slot, link_id, n): distinct trips for each window and link, from fixes (ts, link_id, route_id) that come up to ``late`` late.

    A trip counts once a window and link: later fixes of it are dropped within the watermark, so the state is bounded.
    """
    at = fixes.withWatermark("ts", late).withColumn("slot", F.window("ts", slot)["start"])
    once = at.dropDuplicatesWithinWatermark(["slot", "link_id", "route_id"]) if fixes.isStreaming else at.dropDuplicates(["slot", "link_id", "route_id"])
    return once.groupBy(F.window("ts", slot).alias("w"), "link_id").agg(F.count("*").alias("n")).select(F.col("w.start").alias("slot"), "link_id", "n")


def sessions(pings: DataFrame, gap: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """(did, first, last, n): trips of pings (did, ts).  The gap itself still joins, as in ``trips.sessionize``."""
    at = pings.withWatermark("ts", late)
    by = at.groupBy(F.session_window("ts", gap).alias("w"), "did").agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    return by.select("did", "first", "last", "n")
