"""Map matching: a hidden Markov model over the links near each ping.

Candidates come from an equi-join on the cells of a quad-tree, transitions from joins of neighbouring pings' candidates with a table of
shortest ways on the network, and only the decoding of parts of trips, a batch at a time and never less than a part, is a function in Python.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from wayflow.functions.geo import point_segment, project


def cells(segments: DataFrame, max_dist: float) -> DataFrame:
    """Segments (link_id, lat1, lon1, lat2, lon2) in metres (ax, ay, bx, by), once in each cell (level, cx, cy) that they may be near to.

    A cell of level n has a side of ``max_dist`` * 2 ** n.  A segment is listed at the level whose cells are as large as itself, so it has
    16 cells at most, however long it is.  Segments without a coordinate are left out.
    """
    (ax, ay), (bx, by) = (project(F.col("lat" + k), F.col("lon" + k)) for k in ("1", "2"))
    shape = segments.select("link_id", ax.alias("ax"), ay.alias("ay"), bx.alias("bx"), by.alias("by")).dropna(subset=["ax", "ay", "bx", "by"])
    extent = F.greatest(F.abs(F.col("bx") - F.col("ax")), F.abs(F.col("by") - F.col("ay")))
    shape = shape.withColumn("level", F.ceil(F.log2(F.greatest(extent / max_dist, F.lit(1.0)))).cast("int"))
    side = max_dist * F.pow(F.lit(2.0), F.col("level"))
    span = lambda a, b: F.sequence(F.floor((F.least(a, b) - max_dist) / side), F.floor((F.greatest(a, b) + max_dist) / side))
    return shape.withColumn("cx", F.explode(span(F.col("ax"), F.col("bx")))).withColumn("cy", F.explode(span(F.col("ay"), F.col("by"))))


def candidates(pings: DataFrame, segments: DataFrame, max_dist: float = 400.0) -> DataFrame:
    """``pings`` (route_id, fix_idx, t, lat, lon) with each link within ``max_dist`` metres: link_id, d, along, length.

    A ping looks into its own cell of each level that has segments (see ``cells``).
    """
    shape = cells(segments, max_dist)
    levels = [r.level for r in shape.select("level").distinct().collect()] or [0]  # some tens at most: a level doubles the length
    px, py = project(F.col("lat"), F.col("lon"))
    at = pings.withColumns({"px": px, "py": py}).withColumn("level", F.explode(F.array(*map(F.lit, sorted(levels)))))
    side = max_dist * F.pow(F.lit(2.0), F.col("level"))
    at = at.withColumns({"cx": F.floor(F.col("px") / side), "cy": F.floor(F.col("py") / side)})
    p, a, b = ((F.col(k + "x"), F.col(k + "y")) for k in "pab")
    dx, dy = b[0] - a[0], b[1] - a[1]
    length = F.hypot(dx, dy)
    along = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / F.greatest(dx * dx + dy * dy, F.lit(1e-9)))) * length
    near = at.join(shape, ["level", "cx", "cy"]).withColumns({"d": point_segment(*p, *a, *b), "along": along, "length": length}).where(F.col("d") <= max_dist)
    best = F.min(F.struct("d", "along", "length")).alias("m")  # a link of several segments: its nearest
    return near.groupBy("route_id", "fix_idx", "t", "px", "py", "link_id").agg(best).select("route_id", "fix_idx", "t", "px", "py", "link_id", "m.*")


def reachable(adjacency: DataFrame, lengths: DataFrame, starts: DataFrame) -> DataFrame:
    """(src, dst, gap, way): least metres of whole links between the end of src and the start of dst, and these links in order.

    ``starts`` (src, reach) has the links to start from and the metres that each may go at most.  A round of joins goes one link on from
    every way that has got shorter in the round before, until none does; ways past the reach end at once.  Of ways of the same length
    that with fewest links stays, then the first in order of their ids.  Links without a length can't be passed.
    """
    step = adjacency.select("src", "dst").distinct()
    over = step.join(lengths.where("length IS NOT NULL").select(F.col("link_id").alias("src"), "length"), "src").select(F.col("src").alias("mid"), F.col("dst").alias("next"), "length")
    none = F.array().cast(f"array<{dict(step.dtypes)['src']}>")
    front = starts.join(step, "src").select("src", "dst", "reach", F.lit(0.0).alias("gap"), none.alias("way")).checkpoint()
    found = front
    while not front.isEmpty():
        on = front.join(over, F.col("dst") == F.col("mid")).withColumn("gap", F.col("gap") + F.col("length")).where("gap <= reach")
        least = F.min(F.struct("gap", F.concat("way", F.array("mid")).alias("way"))).alias("m")
        on = on.groupBy("src", F.col("next").alias("dst"), "reach").agg(least).select("src", "dst", "reach", "m.*")
        known = found.select("src", "dst", F.col("gap").alias("known"))
        front = on.join(known, ["src", "dst"], "left").where("known IS NULL OR gap < known").drop("known").checkpoint()
        found = found.join(front, ["src", "dst"], "left_anti").unionByName(front).checkpoint()
    return found.select("src", "dst", "gap", "way")


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``_likeliest`` of rows that come in order of route_id, part, k and link_id: of many parts of trips at once, however short.

    The last part of a batch waits for the rest of it.
    """
    held: list[pa.RecordBatch] = []
    key = lambda b, i: (b["route_id"][i], b["part"][i])
    for b in batches:
        if not b.num_rows:
            continue
        if held and key(held[-1], -1) != key(b, 0):
            yield from _likeliest(held)
            held = []
        new = np.flatnonzero(_changes(b["route_id"], b["part"]))
        if len(new) > 1:
            yield from _likeliest([*held, b.slice(0, int(new[-1]))])
            held, b = [], b.slice(int(new[-1]))
        held.append(b)
    if held:
        yield from _likeliest(held)


def _changes(*columns: pa.Array) -> np.ndarray:
    """True where a row differs from the one before, and at the first."""
    out = np.zeros(len(columns[0]), bool)
    out[0] = True
    for c in columns:
        v = c.to_numpy(zero_copy_only=False)
        out[1:] |= v[1:] != v[:-1]
    return out


def _likeliest(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The likeliest links of whole parts of trips; of equal ones the smallest id.

    Rows have k, fix_idx, t, link_id, along, cost, and srcs and costs, the steps into them.  The first pings of all parts are priced
    at once, then the second ones, and so on.
    """
    rows = pa.Table.from_batches(batches).combine_chunks().to_batches()[0]
    new = _changes(rows["route_id"], rows["part"])
    ping = np.cumsum(new | _changes(rows["k"])) - 1
    start = np.flatnonzero(np.diff(ping, prepend=-1))  # the first row of each ping
    place = np.arange(len(start)) - np.maximum.accumulate(np.where(new[start], np.arange(len(start)), 0))  # of the ping in its part
    sizes = rows["srcs"].value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    names, link = np.unique(np.concatenate([x.to_numpy(zero_copy_only=False) for x in (rows["link_id"], rows["srcs"].flatten())]), return_inverse=True)
    link, src = link[: len(sizes)], link[len(sizes) :]
    own, costs, to = rows["cost"].to_numpy(zero_copy_only=False), rows["costs"].flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(sizes)), sizes)
    before = np.searchsorted(ping * len(names) + link, (ping[to] - 1) * len(names) + src)  # the row that a step comes from
    of_ping, of_row, of_step = (np.argsort(x, kind="stable") for x in (place, place[ping], place[ping[to]]))
    last = int(place.max())
    ends = [np.searchsorted(x, np.arange(last + 2)) for x in (np.sort(place), np.sort(place[ping]), np.sort(place[ping[to]]))]
    best, back = np.full(len(sizes), np.inf), np.full(len(sizes), -1)
    for k in range(last + 1):
        some, steps = of_row[ends[1][k] : ends[1][k + 1]], of_step[ends[2][k] : ends[2][k + 1]]
        total = best[before[steps]] + costs[steps]
        steps, total = steps[np.isfinite(total)], total[np.isfinite(total)]
        order = np.lexsort((src[steps], total, to[steps]))
        first = order[np.flatnonzero(np.diff(to[steps][order], prepend=-1))]
        at = to[steps][first]
        best[at], back[at] = own[at] + total[first], before[steps][first]
        fresh = some[~np.isin(ping[some], ping[at])]  # the first ping of a part, or no way from the one before
        best[fresh] = own[fresh]
    chosen = np.lexsort((best, ping))[start]  # the cheapest row of each ping, by link among equals
    for k in range(last, 0, -1):
        pings = of_ping[ends[0][k] : ends[0][k + 1]]
        way = back[chosen[pings]]
        chosen[pings[way >= 0] - 1] = way[way >= 0]
    out = rows.take(pa.array(chosen)).select(["route_id", "part", "fix_idx", "t", "link_id", "along"])
    yield pa.RecordBatch.from_arrays([*out.columns, pa.array(back[chosen] >= 0)], names=[*out.schema.names, "linked"])


def _matched(pings: DataFrame, segments: DataFrame, adjacency: DataFrame, max_dist: float, sigma: float, beta: float, detour: float, max_leap: float, min_fixes: int) -> tuple[DataFrame, DataFrame]:
    """Decoded pings (route_id, part, fix_idx, t, link_id, along, linked), and the ways that were open to them."""
    long = pings.withColumn("n", F.count("*").over(W.partitionBy("route_id"))).where(F.col("n") >= min_fixes).drop("n")
    near = candidates(long, segments, max_dist).checkpoint()
    trip = W.partitionBy("route_id").orderBy("fix_idx")
    leap = F.hypot(F.lead("px").over(trip) - F.col("px"), F.lead("py").over(trip) - F.col("py"))
    order = near.select("route_id", "fix_idx", "px", "py").distinct().withColumns({"k": F.row_number().over(trip), "leap": leap})
    cut = (F.lag("leap").over(trip) > max_leap).cast("int")
    order = order.withColumn("part", F.coalesce(F.sum(cut).over(trip), F.lit(0))).select("route_id", "fix_idx", "k", "part", "leap")
    near = near.join(order, ["route_id", "fix_idx"]).checkpoint()
    (ax, ay), (bx, by) = (project(F.col("lat" + k), F.col("lon" + k)) for k in ("1", "2"))
    lengths = segments.groupBy("link_id").agg(F.sum(F.hypot(bx - ax, by - ay)).alias("length"))
    leaving = near.where(F.col("leap") <= max_leap)
    ways = reachable(adjacency, lengths, leaving.groupBy(F.col("link_id").alias("src")).agg((F.max("leap") + detour).alias("reach")))
    before = leaving.select("route_id", (F.col("k") + 1).alias("k"), F.col("link_id").alias("src"), "leap", F.col("along").alias("from"), F.col("length").alias("whole"))
    pairs = near.select("route_id", "k", "link_id", "along").join(before, ["route_id", "k"])
    way = pairs.join(ways.select("src", F.col("dst").alias("link_id"), "gap"), ["src", "link_id"], "left")
    ahead = F.when((F.col("src") == F.col("link_id")) & (F.col("along") >= F.col("from")), F.col("along") - F.col("from"))
    network = F.least(ahead, F.col("whole") - F.col("from") + F.col("gap") + F.col("along"))
    steps = way.withColumn("network", network).where(F.col("network") <= F.col("leap") + detour)
    steps = steps.select("route_id", "k", "link_id", F.struct("src", (F.abs(F.col("network") - F.col("leap")) / beta).alias("cost")).alias("step"))
    into = steps.groupBy("route_id", "k", "link_id").agg(F.collect_list("step").alias("steps"))
    cost = (0.5 * F.pow(F.col("d") / sigma, 2)).alias("cost")
    state = near.select("route_id", "part", "k", "fix_idx", "t", "link_id", "along", cost).join(into, ["route_id", "k", "link_id"], "left")
    state = state.select("*", F.col("steps.src").alias("srcs"), F.col("steps.cost").alias("costs")).drop("steps")
    names = dict(state.dtypes)
    schema = ", ".join(f"`{c}` {names[c]}" for c in ("route_id", "part", "fix_idx", "t", "link_id", "along")) + ", linked boolean"
    ordered = state.repartition("route_id", "part").sortWithinPartitions("route_id", "part", "k", "link_id")
    return ordered.mapInArrow(_decode, schema), ways


def match(pings: DataFrame, segments: DataFrame, adjacency: DataFrame, max_dist: float = 400.0, sigma: float = 20.0, beta: float = 50.0, detour: float = 2000.0, max_leap: float = 10_000.0, min_fixes: int = 5) -> DataFrame:
    """(route_id, fix_idx, link_id, t): the likeliest link of each ping of trips with ``min_fixes`` pings or more.

    The probability of a link falls with the square of its distance by ``sigma``, that of a step with the difference between the way
    on the network and the straight line by ``beta``.  A step takes the shortest way, over any number of links without a ping; it is
    impossible where that is more than ``detour`` metres longer than the straight line, or the pings are over ``max_leap`` metres
    apart.  Where no step is possible the chain starts anew; pings without a link near are left out.  Trips without any are absent.
    """
    found, _ = _matched(pings, segments, adjacency, max_dist, sigma, beta, detour, max_leap, min_fixes)
    return found.select("route_id", "fix_idx", "link_id", "t")


def match_paths(pings: DataFrame, segments: DataFrame, adjacency: DataFrame, max_dist: float = 400.0, sigma: float = 20.0, beta: float = 50.0, detour: float = 2000.0, max_leap: float = 10_000.0, min_fixes: int = 5) -> DataFrame:
    """(route_id, fix_idx, i, link_id, emitting, linked): for each ping of ``match`` its own link, and before it those passed without a ping.

    The order is that of fix_idx and i.  ``emitting`` marks the ping's own link; ``linked`` is false where the chain starts anew.
    """
    found, ways = _matched(pings, segments, adjacency, max_dist, sigma, beta, detour, max_leap, min_fixes)
    trip = W.partitionBy("route_id").orderBy("fix_idx")
    rows = found.withColumns({"src": F.lag("link_id").over(trip), "from": F.lag("along").over(trip)})
    moved = F.col("linked") & ~((F.col("src") == F.col("link_id")) & (F.col("along") >= F.col("from")))
    rows = rows.withColumn("src", F.when(moved, F.col("src"))).join(ways.select("src", F.col("dst").alias("link_id"), "way"), ["src", "link_id"], "left")
    between = F.transform(F.coalesce("way", F.array().cast(dict(ways.dtypes)["way"])), lambda x: F.struct(x.alias("link_id"), F.lit(False).alias("emitting")))
    own = F.array(F.struct(F.col("link_id"), F.lit(True).alias("emitting")))
    return rows.select("route_id", "fix_idx", "linked", F.posexplode(F.concat(between, own)).alias("i", "x")).select("route_id", "fix_idx", "i", "x.link_id", "x.emitting", "linked")


def match_counters(pings: DataFrame, matched: DataFrame, min_fixes: int = 5) -> DataFrame:
    """One row: trips, trips that are too short, trips with and without a match."""
    trips = pings.groupBy("route_id").agg((F.count("*") < min_fixes).alias("short"))
    found = matched.select("route_id").distinct().withColumn("found", F.lit(True))
    both = trips.join(found, "route_id", "left")
    return both.agg(F.count("*").alias("trips"), F.count_if("short").alias("too_short"), F.count("found").alias("matched"), F.count_if(~F.col("short") & F.col("found").isNull()).alias("unmatched"))
