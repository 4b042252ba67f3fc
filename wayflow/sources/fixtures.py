"""Inputs of the mobility operators, derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def links(spark: SparkSession, n: int = 100) -> DataFrame:
    """A road graph's links: id, speed, lanes, and the position of the start and end node."""
    i = F.col("id")
    at = lambda k: ((F.floor(k / 10) * 0.01 + 40.70).cast("double"), ((k % 10) * 0.01 - 111.95).cast("double"))
    end = (i * 3 + 1) % 100
    return spark.range(n).select(i.alias("link_id"), (5.0 + (i % 7) * 5).alias("speed"), (1.0 + i % 4).alias("lanes"), at(i)[0].alias("lat1"), at(i)[1].alias("lon1"), at(end)[0].alias("lat2"), at(end)[1].alias("lon2"))


def adjacency(spark: SparkSession, n: int = 100) -> DataFrame:
    """Successors of links, with repeated edges and with links that have none."""
    i = F.col("id")
    return spark.range(n).where("id % 17 != 0").select(i.alias("src"), F.explode(F.array((i + 1) % n, (i * 3 + 1) % n, (i * 7 + 5) % n)).alias("dst"))


def streets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, like ``links``, that grow with the tables: one a part."""
    i, size = F.col("p_partkey"), F.col("p_size")
    at = lambda k: (k * 7919 % 997 * 0.0001 + 40.70, k * 104729 % 991 * 0.0001 - 111.95)
    (lat1, lon1), (lat2, lon2) = at(i), at(i * 31 + 17)
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return part.select(i.alias("link_id"), (5.0 + size % 7 * 5).alias("speed"), (1.0 + size % 4).alias("lanes"), lat1.alias("lat1"), lon1.alias("lon1"), lat2.alias("lat2"), lon2.alias("lon2"))


def passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Successors on ``streets``: parts that follow each other in an order, as often as they do."""
    order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    item = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return item.select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(order).alias("dst")).where("src <> dst")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A calibration run for each line number: the declared sigma, and one measured from its residuals."""
    item = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    d = F.stddev_samp(F.col("l_quantity") * 1.2 + F.col("l_tax") * 10)
    return item.groupBy((F.col("l_linenumber") * 0.5).alias("declared")).agg(F.round(d / 8, 6).alias("measured"))


def pings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Device, order within the device, time in microseconds, position, link."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    u, k = F.col("user_id"), F.col("event_id")
    return e.select(
        u.alias("did"), k.alias("seq"), us.alias("us"), F.get_json_object("props", "$.k").cast("long").alias("link_id"),
        (40.75 + ((u * 37 + F.floor(us / 3600000000)) % 1000) * 0.0001 * (k % 7 + 1)).alias("lat"), (-111.90 + ((u * 53 + k) % 1000) * 0.0001).alias("lon"),
    )


def fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered links of trips: one trip an order."""
    item = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    return item.select(F.col("l_orderkey").alias("route_id"), (F.col("l_suppkey") % 100).alias("link_id"), (F.row_number().over(order) - 1).alias("fix_idx"))


def residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return item.select((F.col("l_quantity") * 1.2 + F.col("l_tax") * 10).alias("d"))


#: The same inputs as DuckDB SQL.
SQL = {
    "links": "links AS (SELECT i AS link_id, CAST(5.0 + (i % 7) * 5 AS DOUBLE) AS speed, CAST(1.0 + i % 4 AS DOUBLE) AS lanes, CAST(i // 10 AS DOUBLE) * CAST(0.01 AS DOUBLE) + CAST(40.70 AS DOUBLE) AS lat1, CAST(i % 10 AS DOUBLE) * CAST(0.01 AS DOUBLE) - CAST(111.95 AS DOUBLE) AS lon1, CAST(((i * 3 + 1) % 100) // 10 AS DOUBLE) * CAST(0.01 AS DOUBLE) + CAST(40.70 AS DOUBLE) AS lat2, CAST((i * 3 + 1) % 10 AS DOUBLE) * CAST(0.01 AS DOUBLE) - CAST(111.95 AS DOUBLE) AS lon2 FROM range(100) t(i))",
    "adjacency": "adjacency AS (SELECT i AS src, unnest([(i + 1) % 100, (i * 3 + 1) % 100, (i * 7 + 5) % 100]) AS dst FROM range(100) t(i) WHERE i % 17 <> 0)",
    "streets": "links AS (SELECT p_partkey AS link_id, CAST(5.0 + p_size % 7 * 5 AS DOUBLE) AS speed, CAST(1.0 + p_size % 4 AS DOUBLE) AS lanes, CAST(p_partkey * 7919 % 997 AS DOUBLE) * CAST(0.0001 AS DOUBLE) + CAST(40.70 AS DOUBLE) AS lat1, CAST(p_partkey * 104729 % 991 AS DOUBLE) * CAST(0.0001 AS DOUBLE) - CAST(111.95 AS DOUBLE) AS lon1, CAST((p_partkey * 31 + 17) * 7919 % 997 AS DOUBLE) * CAST(0.0001 AS DOUBLE) + CAST(40.70 AS DOUBLE) AS lat2, CAST((p_partkey * 31 + 17) * 104729 % 991 AS DOUBLE) * CAST(0.0001 AS DOUBLE) - CAST(111.95 AS DOUBLE) AS lon2 FROM part)",
    "passes": "adjacency AS (SELECT * FROM (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS dst FROM lineitem) WHERE src <> dst)",
    "runs": "runs AS (SELECT CAST(l_linenumber * 0.5 AS DOUBLE) AS declared, round(stddev_samp(CAST(l_quantity AS DOUBLE) * CAST(1.2 AS DOUBLE) + CAST(l_tax AS DOUBLE) * 10) / 8, 6) AS measured FROM lineitem GROUP BY ALL)",
    "pings": "pings AS (SELECT user_id AS did, event_id AS seq, epoch_us(ts) AS us, CAST(json_extract_string(props, '$.k') AS BIGINT) AS link_id, CAST(40.75 AS DOUBLE) + CAST((user_id * 37 + epoch_us(ts) // 3600000000) % 1000 AS DOUBLE) * CAST(0.0001 AS DOUBLE) * (event_id % 7 + 1) AS lat, CAST(-111.90 AS DOUBLE) + CAST((user_id * 53 + event_id) % 1000 AS DOUBLE) * CAST(0.0001 AS DOUBLE) AS lon FROM events)",
    "fixes": "fixes AS (SELECT l_orderkey AS route_id, l_suppkey % 100 AS link_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS fix_idx FROM lineitem)",
    "residuals": "residuals AS (SELECT CAST(l_quantity AS DOUBLE) * CAST(1.2 AS DOUBLE) + CAST(l_tax AS DOUBLE) * 10 AS d FROM lineitem)",
    "counts": "counts AS (SELECT us // 86400000000 AS slot, link_id, CAST(count(DISTINCT did) AS DOUBLE) AS c FROM pings GROUP BY ALL)",
    "prior": "slots AS (SELECT DISTINCT slot FROM counts), dense AS (SELECT s.slot, l.link_id, coalesce(c, 0) + CAST(0.01 AS DOUBLE) AS c FROM slots s CROSS JOIN links l LEFT JOIN counts k ON k.slot = s.slot AND k.link_id = l.link_id), prior AS (SELECT slot, link_id, c / sum(c) OVER (PARTITION BY slot) AS p FROM dense)",
    "weights": "weights AS (SELECT link_id, (speed / (SELECT avg(speed) FROM links)) ** CAST(1.7513 AS DOUBLE) * (lanes / (SELECT avg(lanes) FROM links)) ** CAST(0.4358 AS DOUBLE) AS w FROM links)",
    "kernel": "kernel AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS p FROM adjacency JOIN weights ON dst = link_id)",
}
