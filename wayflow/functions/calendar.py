"""Column functions on a regular grid of slots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def slot_of(us: Column, seconds: int = 300) -> Column:
    """Number of the slot since 1970 that a time in microseconds falls in."""
    return F.floor(us / (seconds * 1_000_000)).cast("long")


def bin_of_week(slot: Column, first: Column | int, per_week: int = 2016) -> Column:
    """Position in a week that starts with the slot ``first``."""
    return F.pmod(slot - first, F.lit(per_week))


def day_of_week(bow: Column, per_day: int = 288, first_day: int = 4) -> Column:
    """Day (0 is Monday) of a position in a week whose first slot is on ``first_day``; a day runs from that slot's time to the same time."""
    return F.pmod(F.lit(first_day) + F.floor(bow / per_day), F.lit(7)).cast("int")


def is_weekend(day: Column) -> Column:
    return day >= 5


def slots(spark: SparkSession, first: str, last: str, minutes: int = 5) -> DataFrame:
    """(slot, label) from ``first`` to ``last``, both included, in steps of ``minutes``."""
    at = F.sequence(F.to_timestamp_ntz(F.lit(first)), F.to_timestamp_ntz(F.lit(last)), F.expr(f"INTERVAL {minutes} MINUTES"))
    return spark.range(1).select(F.explode(at).alias("slot")).select("slot", F.date_format("slot", "yyyy-MM-dd HH:mm:ss").alias("label"))
