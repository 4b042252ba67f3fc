"""Kernels, diffusion and what-if surgery on the link graph, all in long form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from wayflow.functions.geo import unit


#: Speed and lanes of links that have none.
DEFAULT_SPEED, DEFAULT_LANES = 11.17, 1.0


def weights(links: DataFrame, speed: float, lanes: float) -> DataFrame:
    """Mean-normalised speed and lanes to given powers; a mean that isn't positive doesn't divide, and absent values have defaults."""
    known = links.select("link_id", F.coalesce("speed", F.lit(DEFAULT_SPEED)).alias("speed"), F.coalesce("lanes", F.lit(DEFAULT_LANES)).alias("lanes"))
    guard = lambda c: F.when(F.avg(c) > 0, F.avg(c)).otherwise(1.0)
    mean = known.agg(guard("speed").alias("ms"), guard("lanes").alias("ml"))
    return known.crossJoin(F.broadcast(mean)).select("link_id", (F.pow(F.col("speed") / F.col("ms"), speed) * F.pow(F.col("lanes") / F.col("ml"), lanes)).alias("w"))


def turns(adjacency: DataFrame, links: DataFrame, still: float = 0.0) -> DataFrame:
    """(src, dst, turn): cosine of the turn between links (link_id, lat1, lon1, lat2, lon2); ``still`` where one has no direction."""
    ux, uy = unit(F.col("lon2") - F.col("lon1"), F.col("lat2") - F.col("lat1"))
    u = links.select("link_id", ux.alias("ux"), uy.alias("uy"))
    a = adjacency.join(u.toDF("src", "ax", "ay"), "src").join(u.toDF("dst", "bx", "by"), "dst")
    cos = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("ax") * F.col("bx") + F.col("ay") * F.col("by")))
    return a.select("src", "dst", F.when(F.col("ax").isNull() | F.col("bx").isNull(), still).otherwise(cos).alias("turn"))


def angle_kernel(turned: DataFrame, weight: DataFrame, power: float, delta: float = 0.0, mean: float = 1.0) -> DataFrame:
    """Transitions by the weight of dst times ((1 + turn + delta) / mean) ** power, at least 0; power 0 leaves turns out."""
    factor = F.lit(1.0) if power == 0 else F.pow(F.greatest(1.0 + F.col("turn") + delta, F.lit(0.0)) / mean, power)
    rows = turned.join(weight, turned["dst"] == weight["link_id"]).select("src", "dst", (F.col("w") * factor).alias("w"))
    return rows.withColumn("p", F.try_divide("w", F.sum("w").over(W.partitionBy("src")))).where("p IS NOT NULL").select("src", "dst", "p")


def kernel(adjacency: DataFrame, weight: DataFrame | None = None) -> DataFrame:
    """Transition probabilities src to dst in proportion to the weight of dst, or equal ones; repeated edges count each."""
    if weight is None:
        return adjacency.select("src", "dst", (1.0 / F.count("*").over(W.partitionBy("src"))).alias("p"))
    rows = adjacency.join(weight, adjacency["dst"] == weight["link_id"])
    return rows.select("src", "dst", (F.col("w") / F.sum("w").over(W.partitionBy("src"))).alias("p"))


def normalize(rows: DataFrame, value: str, by: str = "slot", empty: str = "zeros") -> DataFrame:
    """Divide by the sum of each slot; a slot that sums to nothing keeps zeros, or gets equal shares of its rows (``uniform``)."""
    w = W.partitionBy(by)
    nothing = 1.0 / F.count("*").over(w) if empty == "uniform" else F.lit(0.0)
    return rows.withColumn(value, F.coalesce(F.try_divide(F.col(value), F.sum(value).over(w)), nothing))


def smoothed(counts: DataFrame, links: DataFrame, uniform: DataFrame, alpha: float = 0.01, gamma: float = 0.20) -> DataFrame:
    """The diffused prior without a dense table: (slot, link_id, p) where counts or their successors are, and ``rest`` elsewhere.

    P (c + alpha) = P c + alpha for links with successors, so only the sparse counts move, and every other link of the slot has one
    of two constants.  Rows have p, the slot's total, and the constants of links with and without successors (p_link, p_dead).
    """
    out = uniform.select(F.col("src").alias("link_id")).distinct()
    sizes = links.select("link_id").join(out.withColumn("alive", F.lit(1)), "link_id", "left").agg(F.count("*").alias("n"), F.count("alive").alias("alive"))
    pulled = counts.join(uniform, counts["link_id"] == uniform["dst"]).groupBy("slot", F.col("src").alias("link_id")).agg(F.sum(F.col("p") * F.col("c")).alias("m"))
    rows = counts.select("slot", "link_id", "c").join(pulled, ["slot", "link_id"], "full").join(out.withColumn("alive", F.lit(1)), "link_id", "left")
    rows = rows.withColumn("s", (1 - gamma) * F.coalesce("c", F.lit(0.0)) + gamma * F.coalesce("m", F.lit(0.0)))
    constant = F.when(F.col("alive") == 1, alpha).otherwise((1 - gamma) * alpha)
    total = F.sum("s").over(W.partitionBy("slot")) + alpha * F.col("n_alive") + (1 - gamma) * alpha * (F.col("n") - F.col("n_alive"))
    rows = rows.crossJoin(F.broadcast(sizes.withColumnRenamed("alive", "n_alive"))).withColumn("total", total)
    return rows.select("slot", "link_id", ((F.col("s") + constant) / F.col("total")).alias("p"), (alpha / F.col("total")).alias("p_link"), ((1 - gamma) * alpha / F.col("total")).alias("p_dead"))


def project(counts: DataFrame, links: DataFrame, last: str | None = None) -> DataFrame:
    """Counts (slot, link_id, c) of links of the graph; other ids go.  Repeated cells are summed, or the one with the greatest ``last`` stands."""
    known = counts.join(links.select("link_id"), "link_id", "left_semi")
    return known.groupBy("slot", "link_id").agg((F.sum("c") if last is None else F.max_by("c", last)).alias("c"))


def at_slots(counts: DataFrame, slots: DataFrame) -> DataFrame:
    """Counts at given slots; a slot without any has one row without a link and with 0, so that it isn't lost."""
    return slots.select("slot").distinct().join(counts, "slot", "left").select("slot", "link_id", F.coalesce("c", F.lit(0.0)).alias("c"))


def between(shares: DataFrame, first, last) -> DataFrame:
    """Slots from ``first`` to ``last``, both included, normalised."""
    return normalize(shares.where(F.col("slot").between(first, last)), "c")


def axis(rows: DataFrame, column: str = "link_id") -> DataFrame:
    """Distinct values with their index in order; one window over the distinct values alone, for vectors that need positions."""
    return rows.select(column).distinct().withColumn("idx", F.row_number().over(W.orderBy(column)) - 1)


def next_week(rows: DataFrame, value: str, week: int, name: str = "q") -> DataFrame:
    """``value`` of a week later, at this week's slot; ``week`` is its length in units of slot."""
    return rows.select((F.col("slot") - week).alias("slot"), "link_id", F.col(value).alias(name))


def in_box(links: DataFrame, south: float, north: float, west: float | None = None, east: float | None = None, along: str | None = None, upward: bool = False, least_speed: float | None = None) -> DataFrame:
    """Links (lat1, lon1, lat2, lon2, speed) whose middle is in the box; ``along`` keeps those that run mostly "lat" or "lon" by 1.5 to 1."""
    dx, dy = F.col("lon2") - F.col("lon1"), F.col("lat2") - F.col("lat1")
    cond = ((F.col("lat1") + F.col("lat2")) / 2).between(south, north)
    if west is not None:
        cond &= ((F.col("lon1") + F.col("lon2")) / 2).between(west, east)
    if along:
        cond &= F.abs(dy) > 1.5 * F.abs(dx) if along == "lat" else F.abs(dx) > 1.5 * F.abs(dy)
    if upward:
        cond &= dy > 0
    if least_speed is not None:
        cond &= F.col("speed") >= least_speed
    return links.where(cond)


def laplace(counts: DataFrame, links: DataFrame, alpha: float = 0.01) -> DataFrame:
    """(slot, link_id, c): ``alpha`` more than the count for every link of every slot."""
    spine = counts.select("slot").distinct().crossJoin(links.select("link_id"))
    return spine.join(counts, ["slot", "link_id"], "left").select("slot", "link_id", (F.coalesce("c", F.lit(0.0)) + alpha).alias("c"))


def diffuse(dense: DataFrame, uniform: DataFrame, gamma: float = 0.20) -> DataFrame:
    """(1 - gamma) of a link's own count and gamma of the mean of its successors', normalised by slot."""
    pulled = dense.join(uniform, dense["link_id"] == uniform["dst"]).groupBy("slot", F.col("src").alias("link_id")).agg(F.sum(F.col("p") * F.col("c")).alias("m"))
    rows = dense.join(pulled, ["slot", "link_id"], "left").select("slot", "link_id", ((1 - gamma) * F.col("c") + gamma * F.coalesce("m", F.lit(0.0))).alias("p"))
    return normalize(rows, "p")


def close_links(adjacency: DataFrame, closed: DataFrame) -> DataFrame:
    """Edges with neither end closed."""
    c = closed.select("link_id")
    return adjacency.join(c, adjacency["src"] == c["link_id"], "left_anti").join(c, adjacency["dst"] == c["link_id"], "left_anti")


def zero_closed(v: DataFrame, closed: F.Column) -> DataFrame:
    return normalize(v.withColumn("v", F.when(closed, 0.0).otherwise(F.col("v"))), "v")


def redistribute(v: DataFrame, closed: F.Column, box: F.Column) -> DataFrame:
    """Closed mass goes to the box in proportion to its mass, in equal parts if it has none."""
    w = W.partitionBy("slot")
    rows = v.withColumns({"gone": F.sum(F.when(closed, F.col("v")).otherwise(0.0)).over(w), "mass": F.sum(F.when(box, F.col("v")).otherwise(0.0)).over(w), "many": F.sum(F.when(box, 1).otherwise(0)).over(w)})
    share = F.when(F.col("mass") > 0, F.col("v") / F.nullif(F.col("mass"), F.lit(0.0))).otherwise(1.0 / F.nullif(F.col("many"), F.lit(0)))
    return rows.withColumn("v", F.when(closed, 0.0).when(box, F.col("v") + F.col("gone") * share).otherwise(F.col("v"))).drop("gone", "mass", "many")


def transfer(v: DataFrame, box: F.Column, psi: float, closed: F.Column | None = None) -> DataFrame:
    """Move the share psi of all mass from outside into the box; closed links stay."""
    b = F.sum(F.when(box, F.col("v")).otherwise(0.0)).over(W.partitionBy("slot"))
    moved = F.when(box, F.col("v") * (1 + psi / b)).otherwise(F.col("v") * (1 - psi / (1 - b)))
    return v.withColumn("v", moved if closed is None else F.when(closed, F.col("v")).otherwise(moved))


def psi_sweep(v: DataFrame, truth: DataFrame, box: F.Column, grid: list[float]) -> DataFrame:
    """Mean absolute (1e-6) and squared (1e-12) error over the box for each psi of the grid, with the mass moved by ``transfer``."""
    b = F.sum(F.when(box, F.col("v")).otherwise(0.0)).over(W.partitionBy("slot"))
    inside = v.withColumn("b", b).where(box).join(truth, ["slot", "link_id"]).withColumn("psi", F.explode(F.array(*map(F.lit, grid))))
    off = F.col("p") - F.col("v") * (1 + F.col("psi") / F.col("b"))
    return inside.groupBy("psi").agg((F.avg(F.abs(off)) * 1e6).alias("mae"), (F.avg(off * off) * 1e12).alias("mse"))


def displacement(shares: DataFrame, uniform: DataFrame, gamma: float = 0.20, weeks: int = 4) -> DataFrame:
    """(bow, link_id, d): mean over weeks of how far diffusion moves a link's share; a week without the link counts what flows into it."""
    key = ["week", "bow", "link_id"]
    pulled = shares.join(uniform, shares["link_id"] == uniform["dst"]).groupBy("week", "bow", F.col("src").alias("link_id")).agg(F.sum(uniform["p"] * shares["p"]).alias("m"))
    moved = F.abs(F.coalesce("m", F.lit(0.0)) - F.coalesce("p", F.lit(0.0))) * gamma
    return shares.select(*key, "p").join(pulled, key, "full").groupBy("bow", "link_id").agg((F.sum(moved) / weeks).alias("d"))
