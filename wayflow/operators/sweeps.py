"""Searching parameters: smoothing strengths, mass transfer, exponents, and what-if reports.  Every grid is a column, not a loop of jobs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from wayflow.operators import chain, graph, stats


def _grid(values: list[float], name: str) -> F.Column:
    return F.explode(F.array(*(F.lit(float(x)) for x in values))).alias(name)


def smoothing_terms(counts: DataFrame, links: DataFrame, uniform: DataFrame, alpha: float = 0.01) -> DataFrame:
    """(slot, link_id, a, pa): counts + alpha and their means over successors, both needed once for any gamma."""
    dense = graph.laplace(counts, links, alpha)
    pulled = dense.join(uniform, dense["link_id"] == uniform["dst"]).groupBy("slot", F.col("src").alias("link_id")).agg(F.sum(F.col("p") * F.col("c")).alias("pa"))
    return dense.join(pulled, ["slot", "link_id"], "left").select("slot", "link_id", F.col("c").alias("a"), F.coalesce("pa", F.lit(0.0)).alias("pa"))


def smoothed_by_gamma(terms: DataFrame, gammas: list[float]) -> DataFrame:
    """(gamma, slot, link_id, p) for every gamma, normalised by slot; totals come from the two terms' totals, so nothing moves."""
    w = W.partitionBy("slot")
    rows = terms.withColumns({"sa": F.sum("a").over(w), "sp": F.sum("pa").over(w)}).select("*", _grid(gammas, "gamma"))
    mixed = lambda a, p: (1 - F.col("gamma")) * F.col(a) + F.col("gamma") * F.col(p)
    return rows.select("gamma", "slot", "link_id", F.coalesce(F.try_divide(mixed("a", "pa"), mixed("sa", "sp")), F.lit(0.0)).alias("p"))


def cross_week_predictions(smooth: DataFrame, first: F.Column, week: int, weeks: int = 4, day: int = 1, dow0: int = 0) -> DataFrame:
    """(gamma, kind, slot, link_id, p, v): truth p and prediction v of a week from the ones before, over all slots of ``weeks`` weeks.

    Kinds: 1w_next, 2w_avg_to_next, 3w_avg_to_next, and the first also by weekday, weekend and day; ``first`` is the first slot,
    ``week`` and ``day`` are lengths in slots, ``dow0`` is the day of the first slot.
    """
    at = smooth.withColumn("i", F.col("slot") - first).where((F.col("i") >= 0) & (F.col("i") < weeks * week))
    at = at.select("gamma", "slot", "link_id", "p", F.floor(F.col("i") / week).alias("w"), F.pmod(F.col("i"), F.lit(week)).alias("bow"))
    key = ["gamma", "bow", "link_id"]
    row = at.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("w", "slot", "p"))).alias("r"))
    part = lambda kind, k, v: F.struct(F.lit(kind).alias("kind"), F.col("r")[k]["slot"].alias("slot"), F.col("r")[k]["p"].alias("p"), v.alias("v"))
    p = lambda k: F.col("r")[k]["p"]
    pairs = [part("1w_next", k, p(k - 1)) for k in range(1, weeks)]
    if weeks > 2:
        pairs.append(part("2w_avg_to_next", 2, (p(0) + p(1)) / 2))
    if weeks > 3:
        pairs.append(part("3w_avg_to_next", 3, (p(0) + p(1) + p(2)) / 3))
    flat = row.where(F.size("r") == weeks).select(*key, F.explode(F.array(*pairs)).alias("x")).select(*key, "x.*")
    dow = F.pmod(F.lit(dow0) + F.floor(F.col("bow") / day), F.lit(7))
    kinds = F.when(F.col("kind") == "1w_next", F.array(F.col("kind"), F.when(dow < 5, "weekday_1w").otherwise("weekend_1w"), F.concat(F.lit("dow"), dow.cast("string"), F.lit("_1w")))).otherwise(F.array("kind"))
    return flat.select("gamma", F.explode(kinds).alias("kind"), "slot", "link_id", "p", "v")


def prediction_errors(pairs: DataFrame, k: int = 100, floor: float = 1e-6) -> DataFrame:
    """(gamma, kind, n, mean and median over slots of the mean relative error, over all links and over the top ``k``)."""
    key = ["gamma", "kind", "slot"]
    rank = F.row_number().over(W.partitionBy(*key).orderBy(F.desc("p"), "link_id"))
    off = pairs.select(*key, (F.abs(F.col("p") - F.col("v")) / (F.col("p") + floor)).alias("off"), rank.alias("r"))
    slots = off.groupBy(*key).agg(F.avg("off").alias("overall"), F.avg(F.when(F.col("r") <= k, F.col("off"))).alias("top"))
    half = lambda c: F.percentile(c, F.lit(0.5))
    return slots.groupBy("gamma", "kind").agg(F.count("*").alias("n"), F.avg("top").alias("top_mean"), half("top").alias("top_median"), F.avg("overall").alias("overall_mean"), half("overall").alias("overall_median"))


def smoothing_displacement(smooth: DataFrame, raw: DataFrame, first: F.Column, week: int, weeks: int = 4) -> DataFrame:
    """(gamma, bow, link_id, d, mean, std, smooth_mean, smooth_std): mean over weeks of |smooth - raw|, and both over weeks (ddof 1)."""
    at = smooth.join(raw.withColumnRenamed("p", "raw"), ["slot", "link_id"], "left").withColumn("i", F.col("slot") - first).where((F.col("i") >= 0) & (F.col("i") < weeks * week))
    raw_p = F.coalesce("raw", F.lit(0.0))
    return at.groupBy("gamma", F.pmod(F.col("i"), F.lit(week)).alias("bow"), "link_id").agg((F.sum(F.abs(F.col("p") - raw_p)) / weeks).alias("d"), (F.sum(raw_p) / weeks).alias("mean"), F.stddev_samp(raw_p).alias("std"), F.avg("p").alias("smooth_mean"), F.stddev_samp("p").alias("smooth_std"))


def fold(link_id: str = "link_id", folds: int = 5, seed: int = 0) -> F.Column:
    """The fold of a link, by a hash: the same on every cluster."""
    return F.pmod(F.xxhash64(F.lit(seed), F.col(link_id)), F.lit(folds)).cast("int")


def transfer_grid(prior: DataFrame, box: F.Column, grid: list[float], closed: F.Column | None = None) -> DataFrame:
    """(psi, slot, link_id, p): the prior with each share psi of the grid moved into the box."""
    b = F.sum(F.when(box, F.col("p")).otherwise(0.0)).over(W.partitionBy("slot"))
    psi = F.col("psi")
    moved = F.when(box, F.col("p") * (1 + psi / F.col("b"))).otherwise(F.col("p") * (1 - psi / (1 - F.col("b"))))
    rows = prior.withColumn("b", b).select("*", _grid(grid, "psi"))
    return rows.select("psi", "slot", "link_id", (moved if closed is None else F.when(closed, F.col("p")).otherwise(moved)).alias("p"))


def psi_errors(prior: DataFrame, truth: DataFrame, box: F.Column, grid: list[float], kernels: list[DataFrame], model: chain.Model, closed: F.Column | None = None, tol: float = 1e-5, max_iter: int = 200) -> DataFrame:
    """(psi, slot, link_id, abs, sq): errors of the chain's vector over the box for every psi (1e-6, 1e-12).  All psi and slots are one job."""
    moved = transfer_grid(prior, box, grid, closed)
    cells = moved.select("psi", "slot").distinct().withColumn("id", F.xxhash64("psi", "slot"))
    start = moved.join(cells, ["psi", "slot"]).select(F.col("id").alias("slot"), "link_id", "p")
    v = chain.stationary(start, kernels, model, tol, max_iter).where(box).select(F.col("slot").alias("id"), "link_id", "v")
    off = F.col("p") - F.col("v")
    return v.join(cells, "id").join(truth, ["slot", "link_id"]).select("psi", "slot", "link_id", (F.abs(off) * 1e6).alias("abs"), (off * off * 1e12).alias("sq"))


def psi_fit(errors: DataFrame, score: str = "sq", folds: int = 5, seed: int = 0, test: F.Column | None = None) -> DataFrame:
    """(part, psi, train, test, base): for each fold of the links the psi with the least training error, its test error and that of psi 0.

    ``test`` marks the links of a single split instead, part 0.
    """
    part = F.explode(F.sequence(F.lit(0), F.lit(folds - 1))) if test is None else F.lit(0)
    held = (fold(folds=folds, seed=seed) == F.col("part")) if test is None else test
    rows = errors.select("*", part.alias("part")).withColumn("held", held)
    mean = rows.groupBy("part", "psi").agg(F.avg(F.when(~F.col("held"), F.col(score))).alias("train"), F.avg(F.when(F.col("held"), F.col(score))).alias("test"))
    base = mean.where(F.abs("psi") < 1e-12).select("part", F.col("test").alias("base"))
    return stats.best(mean, "train", "psi", ["part"]).join(base, "part").select("part", "psi", "train", "test", "base")


def psi_table(errors: DataFrame, by: F.Column, name: str = "hour") -> DataFrame:
    """(name, whole, psi, mae, mse, base_mae, base_mse): the psi of the least squared error for each value of ``by``, and over all rows.

    ``errors`` are those of ``psi_errors``; of equal psi the smallest.  The row over all has ``whole`` and no ``name``; a null ``by`` is
    a group.  Base is psi 0.  One aggregation by psi and ``by`` serves both levels.
    """
    sums = [F.sum(c).alias(c) for c in ("abs", "sq")]
    cells = errors.groupBy("psi", by.alias(name)).agg(*sums, F.count("*").alias("n"))
    mean = cells.rollup("psi", name).agg(F.grouping("psi").alias("none"), (F.grouping(name) == 1).alias("whole"), (F.sum("abs") / F.sum("n")).alias("mae"), (F.sum("sq") / F.sum("n")).alias("mse")).where("none = 0")
    base = F.max(F.when(F.abs("psi") < 1e-12, F.struct("mae", "mse"))).alias("base")
    best = mean.groupBy("whole", name).agg(F.min_by(F.struct("psi", "mae", "mse"), F.struct("mse", "psi")).alias("best"), base)
    return best.select(name, "whole", "best.*", F.col("base.mae").alias("base_mae"), F.col("base.mse").alias("base_mse"))


def event_report(prior: DataFrame, truth: DataFrame, adjacency: DataFrame, links: DataFrame, closed: F.Column, box: F.Column, powers: dict[str, list[tuple[float, float]]], models: dict[str, chain.Model], floor: float = 1e-6, tol: float = 1e-5, max_iter: int = 200) -> DataFrame:
    """(model, surgery, box_mean, box_dev, whole_mean, whole_dev): errors around a closure.

    ``none`` leaves prior and kernel; ``surgery2`` moves the closed links' prior to the box and takes them out of the graph;
    ``surgery_box`` also moves the target's.  Predictions lose what they put on closed links.  ``powers`` has for each model the
    exponents of speed and lanes of its kernels.
    """
    shut = links.where(closed)
    open_ = graph.close_links(adjacency, shut)
    as_v = lambda df: df.withColumnRenamed("p", "v")
    as_p = lambda df: df.withColumnRenamed("v", "p")
    moved = as_p(graph.redistribute(as_v(prior), closed, box))
    targets = {"zero": as_p(graph.zero_closed(as_v(truth), closed)), "box": as_p(graph.redistribute(as_v(truth), closed, box))}
    out = None
    for name, model in models.items():
        for surgery in ("none", "surgery2", "surgery_box"):
            edges, start = (adjacency, prior) if surgery == "none" else (open_, moved)
            kernels = [graph.kernel(edges, graph.weights(links, *x)) for x in powers[name]]
            v = graph.zero_closed(chain.stationary(start, kernels, model, tol, max_iter).select("slot", "link_id", "v"), closed)
            off = v.join(targets["box" if surgery == "surgery_box" else "zero"], ["slot", "link_id"]).select("slot", (F.abs(F.col("p") - F.col("v")) / (F.col("p") + floor)).alias("off"), box.alias("box"), closed.alias("closed"))
            slots = off.groupBy("slot").agg(F.avg(F.when(F.col("box"), F.col("off"))).alias("b"), F.avg(F.when(~F.col("closed"), F.col("off"))).alias("w"))
            row = slots.agg(F.avg("b").alias("box_mean"), F.stddev_pop("b").alias("box_dev"), F.avg("w").alias("whole_mean"), F.stddev_pop("w").alias("whole_dev")).select(F.lit(name).alias("model"), F.lit(surgery).alias("surgery"), "*")
            out = row if out is None else out.unionByName(row)
    return out


def fit_exponents(loss: Callable[[list[tuple[float, ...]]], list[float]], starts: list[tuple[float, ...]], step: float = 0.5, least: float = 1e-2, max_rounds: int = 40, lower: tuple[float | None, ...] | None = None) -> tuple[tuple[float, ...], float]:
    """Exponents of the least loss by a pattern search from several starts; every round prices all starts' neighbours in one call.

    A start moves to its best neighbour at its step, or halves the step; it ends when that is below ``least``.  ``lower`` bounds exponents.
    """
    bound = lambda x: tuple(v if lower is None or lower[i] is None else max(lower[i], v) for i, v in enumerate(x))
    points = [bound(s) for s in starts]
    values = loss(points)
    steps = [step] * len(points)
    for _ in range(max_rounds):
        live = [k for k in range(len(points)) if steps[k] >= least]
        if not live:
            break
        asked = [(k, bound(tuple(v + (d * steps[k] if i == j else 0) for j, v in enumerate(points[k])))) for k in live for i in range(len(points[k])) for d in (1, -1)]
        priced = list(zip(asked, loss([x for _, x in asked]), strict=True))
        for k in live:
            (_, x), f = min((p for p in priced if p[0][0] == k), key=lambda p: p[1])
            if f < values[k] - 1e-12:
                points[k], values[k] = x, f
            else:
                steps[k] /= 2
    best = min(range(len(points)), key=lambda k: values[k])
    return points[best], values[best]


def chain_loss(prior: DataFrame, truth: DataFrame, adjacency: DataFrame, links: DataFrame, model: chain.Model = chain.Model(), tol: float = 1e-5, max_iter: int = 100) -> Callable[[list[tuple[float, ...]]], list[float]]:
    """Mean relative error of the single-phase chain for each (speed, lanes) pair asked for; a job a pair."""

    def loss(points: list[tuple[float, ...]]) -> list[float]:
        out = []
        for speed, lanes in points:
            v = chain.stationary(prior, [graph.kernel(adjacency, graph.weights(links, speed, lanes))], model, tol, max_iter)
            out.append(stats.relative_error(v.select("slot", "link_id", "v"), truth).agg(F.avg("mre")).first()[0])
        return out

    return loss
