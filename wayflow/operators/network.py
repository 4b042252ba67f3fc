"""Building directed edges, measuring fixes against link shapes, and reports over links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayflow.functions.geo import point_segment, project


def directed_edges(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct (a, b) between successive ``nodes`` of ways (way_id, nodes, oneway); both ends must be in ``nodes`` (id)."""
    steps = ways.select("oneway", F.posexplode("nodes").alias("i", "a"), "nodes").select("oneway", "a", F.try_element_at("nodes", F.col("i") + 2).alias("b")).where("a != b")
    ends = F.struct(F.col("a").alias("a"), F.col("b").alias("b"))
    turned = F.struct(F.col("b").alias("a"), F.col("a").alias("b"))
    both = F.when(F.col("oneway") == "-1", F.array(turned)).when(F.col("oneway").isin("yes", "true", "1"), F.array(ends)).otherwise(F.array(ends, turned))
    edges = steps.select(F.inline(both)).distinct()
    known = nodes.select("id").distinct()
    return edges.join(known.withColumnRenamed("id", "a"), "a", "left_semi").join(known.withColumnRenamed("id", "b"), "b", "left_semi").select("a", "b")


def measure_residuals(fixes: DataFrame, segments: DataFrame, key: list[str]) -> DataFrame:
    """``key`` and d: the least distance of each fix (link_id, lat, lon) from the segments (link_id, lat1, lon1, lat2, lon2) of its link."""
    (px, py), (ax, ay), (bx, by) = (project(F.col("lat" + k), F.col("lon" + k)) for k in ("", "1", "2"))
    return fixes.join(segments, "link_id").groupBy(*key).agg(F.min(point_segment(px, py, ax, ay, bx, by)).alias("d"))


def subedge_segments(subedges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Segments (link_id, lat1, lon1, lat2, lon2) of sub-edges (a, b, link_id) between known nodes (id, lat, lon)."""
    end = lambda k, n: nodes.select(F.col("id").alias(n), F.col("lat").alias(f"lat{k}"), F.col("lon").alias(f"lon{k}"))
    return subedges.join(end(1, "a"), "a").join(end(2, "b"), "b").select("link_id", "lat1", "lon1", "lat2", "lon2")


def trip_residuals(fixes: DataFrame, pings: DataFrame, segments: DataFrame, min_links: int = 3) -> tuple[DataFrame, DataFrame]:
    """Distances of matched fixes (route_id, fix_idx, link_id, t) from their links, and how many fixes could not be measured.

    A fix stands where its trip's ping (route_id, sec, lat, lon, seq) of the same second is; of several the last one counts.  Trips
    with fewer than ``min_links`` distinct links, and those without pings, are left out; the counters are fixes on links without
    segments, and others without a ping.
    """
    enough = fixes.groupBy("route_id").agg(F.count_distinct("link_id").alias("n")).where(F.col("n") >= min_links).select("route_id")
    last = pings.groupBy("route_id", "sec").agg(F.max_by(F.struct("lat", "lon"), "seq").alias("at"))
    asked = fixes.join(enough, "route_id", "left_semi").join(last.select("route_id").distinct(), "route_id", "left_semi").withColumn("sec", F.bround("t").cast("long"))
    shapes = segments.select("link_id").distinct().withColumn("shape", F.lit(True))
    placed = asked.join(shapes, "link_id", "left").join(last, ["route_id", "sec"], "left")
    skipped = placed.agg(F.count_if(F.col("shape").isNull()).alias("no_shape"), F.count_if(F.col("shape") & F.col("at").isNull()).alias("no_ping"))
    good = placed.where("shape AND at IS NOT NULL").select("route_id", "fix_idx", "link_id", "at.lat", "at.lon")
    return measure_residuals(good, segments, ["route_id", "fix_idx"]), skipped


def walk_chains(edges: DataFrame, ends: DataFrame, links: DataFrame, max_steps: int = 1000) -> DataFrame:
    """(a, b, link_id): the sub-edges of directed ``edges`` (a, b) that make up each link (link_id, u, v) between two end nodes (id).

    From an end node every out-edge is followed while its head is no end and has exactly one way on other than back; walks back to
    their start and walks of more than ``max_steps`` are given up.  A sub-edge on several links goes to the smallest id.

    Where a walk goes on is known from the least and the greatest head of a node that has two at most, so a step looks up nodes, not
    pairs of edges.  Steps come in groups that double up to 16, so that short walks leave early and a part of a walk is a short array.
    """
    ends, by_tail = ends.select("id").distinct(), edges.select("a", "b").repartition("a").distinct()
    heads = by_tail.groupBy("a").agg(F.min("b").alias("lo"), F.max("b").alias("hi"), F.count("b").alias("n")).where("n <= 2").drop("n")
    through = heads.join(ends.withColumnRenamed("id", "a"), "a", "left_anti").select(F.col("a").alias("b"), "lo", "hi").checkpoint()
    front = by_tail.join(ends.withColumnRenamed("id", "a"), "a", "left_semi").select(F.col("a").alias("start"), F.col("b").alias("first"), "a", "b", F.array("a", "b").alias("path"))
    parts, taken, group = None, 0, 2
    while True:
        for _ in range(min(group, max_steps - taken)):
            on = F.when((F.col("lo") == F.col("hi")) & (F.col("lo") != F.col("a")), F.col("lo")).when(F.col("lo") != F.col("hi"), F.when(F.col("lo") == F.col("a"), F.col("hi")).when(F.col("hi") == F.col("a"), F.col("lo")))
            front = front.join(through, "b", "left").withColumn("c", on)
            path = F.when(F.col("c").isNull(), F.col("path")).otherwise(F.concat("path", F.array("c")))
            a, b = F.when(F.col("c").isNull(), F.col("a")).otherwise(F.col("b")), F.coalesce("c", "b")
            front = front.select("start", "first", a.alias("a"), b.alias("b"), path.alias("path"), F.col("c").isNotNull().alias("open"))
        taken, group = taken + min(group, max_steps - taken), min(2 * group, 16)
        part = front.checkpoint() if taken else front.withColumn("open", F.lit(False))
        parts = part if parts is None else parts.unionByName(part)
        front = part.where("open").withColumn("path", F.array("b"))
        if taken >= max_steps or front.isEmpty():
            break
    done = parts.where("NOT open AND b != start").join(ends.withColumnRenamed("id", "b"), "b", "left_semi").select("start", "first", F.col("b").alias("last"))
    if taken:  # the last part of a walk of just max_steps is open, and at its end
        cut = part.where("open AND b != start").join(ends.withColumnRenamed("id", "b"), "b", "left_semi").select("start", "first", F.col("b").alias("last"))
        done = done.unionByName(cut) if taken >= max_steps else done
    named = done.join(links.select(F.col("u").alias("start"), F.col("v").alias("last"), "link_id"), ["start", "last"]).groupBy("start", "first").agg(F.min("link_id").alias("link_id"))
    walked = parts.select("start", "first", "path").where(F.size("path") > 1).join(named, ["start", "first"])
    pairs = F.arrays_zip(F.slice("path", F.lit(1), F.size("path") - 1).alias("a"), F.slice("path", F.lit(2), F.size("path") - 1).alias("b"))
    return walked.select(F.inline(pairs).alias("a", "b"), "link_id").groupBy("a", "b").agg(F.min("link_id").alias("link_id"))


def compare_buckets(links: DataFrame, before: DataFrame, after: DataFrame, at: tuple[float, ...] = (0.2, 0.4, 0.6, 0.8, 0.99, 1.0)) -> DataFrame:
    """``length_buckets`` of two counts side by side: gain in coverage, and how many times more trips a link has."""
    one, two = (length_buckets(links, c, at).select("bucket", "links", F.col("coverage").alias(f"coverage{k}"), F.col("mean_trips").alias(f"trips{k}")) for k, c in ((1, before), (2, after)))
    return one.join(two.drop("links"), "bucket").withColumns({"delta": F.col("coverage2") - F.col("coverage1"), "ratio": F.try_divide("trips2", "trips1")})


def coverage_gain(links: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """Links with a trip in each of two counts (link_id, n), of how many, and those that only the second has."""
    has = lambda c, name: c.where("n > 0").select("link_id", F.lit(1).alias(name))
    both = links.select("link_id").join(has(before, "one"), "link_id", "left").join(has(after, "two"), "link_id", "left")
    return both.agg(F.count("*").alias("links"), F.count("one").alias("covered1"), F.count("two").alias("covered2"), F.count_if(F.col("one").isNull() & F.col("two").isNotNull()).alias("extra"))


def length_buckets(links: DataFrame, counts: DataFrame, at: tuple[float, ...] = (0.2, 0.4, 0.6, 0.8, 0.99, 1.0)) -> DataFrame:
    """Links (link_id, length) by the first quantile that their length doesn't pass: number, share with trips, mean trips (link_id, n)."""
    edges = links.agg(F.percentile("length", F.array(*map(F.lit, at))).alias("edges"))
    rows = links.join(counts, "link_id", "left").crossJoin(F.broadcast(edges))
    first = F.size(F.filter("edges", lambda e: e < F.col("length")))
    trips = F.coalesce("n", F.lit(0))
    return rows.groupBy(first.cast("long").alias("bucket")).agg(F.count("*").alias("links"), F.avg((trips > 0).cast("double")).alias("coverage"), F.avg(trips.cast("double")).alias("mean_trips"))


def trips_per_link(fixes: DataFrame) -> DataFrame:
    """(link_id, n): distinct trips of each link."""
    return fixes.groupBy("link_id").agg(F.count_distinct("route_id").alias("n"))


def noise_bands(cells: DataFrame, floor: float) -> DataFrame:
    """Cells (mean, std) as EMPTY, SUBNOISE, MIXED or SIGNAL against a noise floor."""
    std = F.col("std")
    return cells.withColumn("band", F.when(F.col("mean") == 0, "EMPTY").when(std < floor / 2, "SUBNOISE").when(std <= 2 * floor, "MIXED").otherwise("SIGNAL"))
