"""Fits, robust statistics, histograms and error metrics."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType
from pyspark.sql.window import Window as W


def quantiles(rows: DataFrame, value: str, at: list[float], bins: int = 4096, small: int = 100_000) -> list[float]:
    """Exact quantiles with linear interpolation, without gathering all values in a task.

    Each pass counts equal bins of an interval and goes on with the bin that holds the rank, until it has ``small`` rows or one
    value; the ends of an interval are never in one bin, so it always shrinks.  Nulls and NaN are left out, infinities are the first and
    the last ranks.  No rows: NaN, and so is what lies between two infinities.
    """
    rows = rows.select(F.col(value).cast("double").alias("x")).where("x IS NOT NULL AND NOT isnan(x)")
    finite = F.abs("x") < math.inf
    below, within, n, low, high = rows.agg(F.count_if(F.col("x") == -math.inf), F.count_if(finite), F.count("*"), F.min(F.when(finite, F.col("x"))), F.max(F.when(finite, F.col("x")))).first()
    if not n:
        return [math.nan] * len(at)
    rows = rows.where(finite)

    def counted(a: float, z: float) -> list[tuple[int, int, float, float]]:
        by = 1.0 if math.isfinite(z - a) else 0.5  # halves of the largest numbers have a finite distance
        spot = F.least(F.floor((F.col("x") * by - a * by) / (z * by - a * by) * bins), F.lit(bins - 1)).cast("int")
        return sorted(tuple(r) for r in rows.where(F.col("x").between(a, z)).groupBy(spot.alias("bin")).agg(F.count("*"), F.min("x"), F.max("x")).collect())

    ranks = {math.floor(q * (n - 1)) for q in at} | {math.ceil(q * (n - 1)) for q in at}
    found: dict[int, float] = {r: -math.inf if r < below else math.inf for r in ranks if not below <= r < below + within}
    wanted = sorted(r - below for r in ranks - found.keys())
    tops = counted(low, high) if wanted and high > low else [(0, within, low, high)]
    while wanted:
        r, before, level = wanted[0], 0, tops
        while True:
            for _, count, a, z in level:
                if r < before + count:
                    break
                before += count
            if a == z or count <= small:
                break
            level = counted(a, z)
        here = [k for k in wanted if k < before + count]
        values = None if a == z else [x.x for x in rows.where(F.col("x").between(a, z)).orderBy("x").collect()]
        found |= {k + below: a if values is None else values[k - before] for k in here}
        wanted = wanted[len(here) :]

    def mixed(spot: float) -> float:
        a, z, part = found[math.floor(spot)], found[math.ceil(spot)], spot % 1
        return a if a == z else a * (1 - part) + z * part

    return [mixed(q * (n - 1)) for q in at]


def grouped_quantiles(rows: DataFrame, keys: list[str], values: list[str], at: list[float]) -> DataFrame:
    """``keys``, and for each of ``values`` the array of its exact quantiles ``at`` in a group, with linear interpolation.

    Values are counted, then sorted by group and value in ranges, so that a group of any size spreads over as many tasks as it has
    distinct values for; offsets of the ranges and running counts within them give ranks.  Four shuffles, whatever the data.  Nulls and
    NaN are left out and null keys are a group; infinities count, and half way between two of them is NaN.  A group without values has
    nulls.  Needs a checkpoint folder.
    """
    key = F.struct(*keys).alias("key")
    named = F.array(*(F.struct(F.lit(v).alias("name"), F.col(v).cast("double").alias("x")) for v in values))
    long = rows.select(key, F.inline(named)).where("x IS NOT NULL AND NOT isnan(x)").select(F.struct("key", "name").alias("g"), "x")
    counted = long.groupBy("g", "x").agg(F.count("*").alias("n"))
    spread = counted.repartitionByRange("g", "x").withColumn("bin", F.spark_partition_id()).checkpoint()
    whole = W.partitionBy("g")
    sums = spread.groupBy("g", "bin").agg(F.sum("n").alias("n"))  # a row a range, and one more for each group that starts in it
    offsets = sums.select("g", "bin", (F.sum("n").over(whole.orderBy("bin")) - F.col("n")).alias("before"), F.sum("n").over(whole).alias("total"))
    upto = F.col("before") + F.sum("n").over(W.partitionBy("g", "bin").orderBy("x"))
    ranked = spread.join(offsets, ["g", "bin"]).select("g", "x", "total", upto.alias("upto"))
    spot = lambda q: F.lit(q) * (F.col("total") - 1)
    ends = [F.min(F.when(F.col("upto") > f(spot(q)), F.col("x"))).alias(f"{k}{i}") for i, q in enumerate(at) for k, f in (("a", F.floor), ("z", F.ceil))]
    found = ranked.groupBy("g", "total").agg(*ends)
    part = lambda q: spot(q) - F.floor(spot(q))
    mixed = [F.when(F.col(f"a{i}") == F.col(f"z{i}"), F.col(f"a{i}")).otherwise(F.col(f"a{i}") * (1 - part(q)) + F.col(f"z{i}") * part(q)) for i, q in enumerate(at)]
    each = found.select("g", F.array(*mixed).alias("q")).groupBy("g.key").agg(*(F.first(F.when(F.col("g.name") == v, F.col("q")), ignorenulls=True).alias(v) for v in values))
    return rows.select(key).distinct().join(each, "key", "left").select("key.*", *values)


def robust(residuals: DataFrame, limit: float = 30.0, percentiles: tuple[float, ...] = (0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 0.999)) -> DataFrame:
    """One row: rows, rows dropped beyond ``limit`` and their share, mean, std (ddof 1), IQR and MAD sigmas, percentiles of the rest; mean and std before."""
    kept = residuals.where(F.col("d") <= limit)
    names = ["mean", "sigma_std"]
    after = kept.agg(F.count("*").alias("n"), F.avg("d").alias("mean"), F.stddev_samp("d").alias("sigma_std"))
    before = residuals.agg(F.count("*").alias("n_all"), F.avg("d").alias("mean_all"), F.stddev_samp("d").alias("sigma_all"))
    at = [0.25, 0.5, 0.75, *percentiles]
    q = quantiles(kept, "d", at)
    mad = quantiles(kept.select(F.abs(F.col("d") - q[1]).alias("off")), "off", [0.5])[0]
    out = after.crossJoin(before).select("n", *names, F.lit(q[1]).alias("median"), F.lit((q[2] - q[0]) / 1.349).alias("sigma_iqr"), F.lit(mad / 0.6745).alias("sigma_mad"), "n_all", "mean_all", "sigma_all", F.array(*map(F.lit, q[3:])).alias("percentiles"))
    return out.withColumns({"dropped": F.col("n_all") - F.col("n"), "dropped_pct": F.try_divide(100.0 * (F.col("n_all") - F.col("n")), F.col("n_all"))})


def histogram(residuals: DataFrame, width: float = 0.25, bins: int = 200) -> DataFrame:
    """Counts of equal bins; the last one is closed, larger values are bin -1."""
    at = F.when(F.col("d") > width * bins, -1).otherwise(F.least(F.floor(F.col("d") / width), F.lit(bins - 1)))
    return residuals.groupBy(at.cast("long").alias("bin")).agg(F.count("*").alias("n"))


def geometric_fit(lengths: DataFrame, column: str) -> DataFrame:
    """Moment fit of a geometric distribution from 0, and the variance that it implies."""
    m = F.avg(column)
    return lengths.agg(F.count("*").alias("n"), m.alias("mean"), F.var_samp(column).alias("var"), (1 / (1 + m)).alias("p"), (m * (1 + m)).alias("geom_var"))


def ks_geometric(lengths: DataFrame, column: str) -> DataFrame:
    """Largest distance of the empirical distribution from the fitted geometric one, at the lengths that occur and just before."""
    total = lengths.agg(F.count("*").alias("n"), (1 / (1 + F.avg(column))).alias("p"), (F.max(column) + 1).alias("last"))
    spine = total.select("n", "p", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last").cast("long"))).alias("k"))
    count = lengths.groupBy(F.col(column).cast("long").alias("k")).agg(F.count("*").alias("c"))
    run = F.sum(F.coalesce("c", F.lit(0))).over(W.orderBy("k")) / F.col("n")  # one row for each length: small
    return spine.join(count, "k", "left").select(F.abs(run - (1 - F.pow(1 - F.col("p"), F.col("k") + 1))).alias("gap")).agg(F.max("gap").alias("ks"))


@F.pandas_udf(DoubleType())
def chi2_tail(x: pd.Series, dof: pd.Series) -> pd.Series:
    """Probability that chi-square with ``dof`` (a whole number) degrees of freedom is above x: the finite sums for even and odd dof."""

    def tail(x: float, dof: int) -> float:
        half = x / 2
        if half <= 0:
            return 1.0
        odd = dof % 2
        total = math.erfc(math.sqrt(half)) if odd else 0.0
        for k in range(dof // 2):
            k = k + 0.5 * odd
            total += math.exp(k * math.log(half) - half - math.lgamma(k + 1))
        return min(1.0, total)

    return pd.Series([tail(a, int(b)) for a, b in zip(x, dof, strict=True)])


def chi2_geometric(lengths: DataFrame, column: str, least: float = 5.0) -> DataFrame:
    """Pearson's chi-square against the fitted geometric distribution: chi2, dof, chi2_per_dof, pval, bins.

    Lengths are pooled from 0 upwards until ``least`` are expected; the rest is the last bin, with all mass beyond the largest length,
    and expected counts are scaled to the observed total.  Two degrees of freedom go, and one always stays.
    """
    total = lengths.agg(F.count("*").cast("double").alias("n"), (1 / (1 + F.avg(column))).alias("p"), F.max(column).cast("long").alias("last"))
    spine = total.select("n", "p", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))).alias("k"))
    count = lengths.groupBy(F.col(column).cast("long").alias("k")).agg(F.count("*").alias("o"))
    cells = spine.join(count, "k", "left").select("n", "k", F.coalesce("o", F.lit(0)).cast("double").alias("o"), (F.pow(1 - F.col("p"), F.col("k")) * F.col("p") * F.col("n")).alias("e"))
    # One row for each length: small.  Pooling depends on the order, so it folds a sorted array.
    packed = cells.groupBy("n").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "o", "e"))), lambda c: F.struct(c["o"].alias("o"), c["e"].alias("e"))).alias("cells"))
    empty = F.array().cast("array<struct<o:double,e:double>>")
    zero = F.struct(F.lit(0.0).alias("o"), F.lit(0.0).alias("e"))

    def pool(acc: F.Column, c: F.Column) -> F.Column:
        now = F.struct((acc["at"]["o"] + c["o"]).alias("o"), (acc["at"]["e"] + c["e"]).alias("e"))
        full = now["e"] >= least
        return F.struct(F.when(full, F.concat(acc["bins"], F.array(now))).otherwise(acc["bins"]).alias("bins"), F.when(full, zero).otherwise(now).alias("at"))

    folded = packed.select("n", "cells", F.aggregate("cells", F.struct(empty.alias("bins"), zero.alias("at")), pool).alias("f"))
    rest = F.col("f.at.e") + F.col("n") - F.aggregate("cells", F.lit(0.0), lambda a, c: a + c["e"])
    bins = folded.select(F.when(rest > 0, F.concat(F.col("f.bins"), F.array(F.struct(F.col("f.at.o").alias("o"), rest.alias("e"))))).otherwise(F.col("f.bins")).alias("bins"))
    scale = F.aggregate("bins", F.lit(0.0), lambda a, c: a + c["o"]) / F.aggregate("bins", F.lit(0.0), lambda a, c: a + c["e"])
    chi2 = bins.withColumn("scale", scale).select(F.size("bins").alias("bins"), F.aggregate("bins", F.lit(0.0), lambda a, c: a + F.pow(c["o"] - c["e"] * F.col("scale"), 2) / (c["e"] * F.col("scale"))).alias("chi2"))
    chi2 = chi2.withColumn("dof", F.greatest(F.col("bins") - 2, F.lit(1)))
    return chi2.select("chi2", "dof", (F.col("chi2") / F.col("dof")).alias("chi2_per_dof"), chi2_tail("chi2", "dof").alias("pval"), "bins")


def phase_rates(lengths: DataFrame) -> DataFrame:
    """beta and rho: the moment fits of the way up and down."""
    return lengths.agg((1 / (1 + F.avg("l_up"))).alias("beta"), (1 / (1 + F.avg("l_down"))).alias("rho"))


def compare_fits(datasets: dict[str, DataFrame]) -> DataFrame:
    """For each set of phases (k, l_up, l_down): KS and chi-square per dof of the whole length against the mean of the two phases'."""
    out = None
    for name, d in datasets.items():
        parts = {"single": d.select((F.col("l_up") + F.col("l_down") + 1).alias("x")), "up": d.select(F.col("l_up").alias("x")), "down": d.select(F.col("l_down").alias("x"))}
        row = None
        for variant, lengths in parts.items():
            one = ks_geometric(lengths, "x").crossJoin(chi2_geometric(lengths, "x").select("chi2_per_dof")).toDF(f"ks_{variant}", f"chi2_{variant}")
            row = one if row is None else row.crossJoin(one)
        row = row.select(F.lit(name).alias("dataset"), "*")
        for m in ("ks", "chi2"):
            split = (F.col(f"{m}_up") + F.col(f"{m}_down")) / 2
            row = row.withColumn(f"{m}_split", split).withColumn(f"{m}_improvement", F.try_divide(100 * (F.col(f"{m}_single") - split), F.col(f"{m}_single")))
        out = row if out is None else out.unionByName(row)
    return out


def log_bins(rows: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """(bin, n): values clipped to [low, high] and counted in bins of equal ratio; the last one is closed."""
    x = F.greatest(F.lit(low), F.least(F.lit(high), F.col(value)))
    at = F.least(F.floor(F.log10(x / low) / (math.log10(high / low) / bins)), F.lit(bins - 1)).cast("int")
    return rows.groupBy(at.alias("bin")).agg(F.count("*").alias("n"))


def box_errors(v: DataFrame, truth: DataFrame, box: F.Column) -> DataFrame:
    """Mean absolute error (1e-6) and squared error (1e-12) of v against p over the links of ``box``."""
    off = F.col("p") - F.col("v")
    return v.where(box).join(truth, ["slot", "link_id"]).agg((F.avg(F.abs(off)) * 1e6).alias("mae"), (F.avg(off * off) * 1e12).alias("mse"))


def relative_error(v: DataFrame, truth: DataFrame, floor: float = 1e-6) -> DataFrame:
    """Mean relative error of each slot."""
    return truth.join(v, ["slot", "link_id"]).groupBy("slot").agg(F.avg(F.abs(F.col("p") - F.col("v")) / (F.col("p") + floor)).alias("mre"))


def cross_week(shares: DataFrame, weeks: int = 4, ddof: int = 1) -> DataFrame:
    """Mean and std over weeks for each slot of the week and link, with absent weeks as zeros, and the number of zero weeks."""
    at = shares.groupBy("bow", "link_id").agg(F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("q"), F.count(F.when(F.col("p") > 0, 1)).alias("some"))
    var = F.greatest(F.lit(0.0), (F.col("q") - F.col("s") * F.col("s") / weeks) / (weeks - ddof))
    return at.select("bow", "link_id", (F.col("s") / weeks).alias("mean"), F.sqrt(var).alias("std"), (weeks - F.col("some")).alias("zeros"))


def top_error(v: DataFrame, truth: DataFrame, k: int = 100, floor: float = 1e-6) -> DataFrame:
    """Mean relative error of each slot over all links, and over the ``k`` with most truth; ties go to the smaller id."""
    rank = F.row_number().over(W.partitionBy("slot").orderBy(F.desc("p"), "link_id"))
    off = truth.join(v, ["slot", "link_id"]).select("slot", (F.abs(F.col("p") - F.col("v")) / (F.col("p") + floor)).alias("off"), rank.alias("r"))
    return off.groupBy("slot").agg(F.avg("off").alias("overall"), F.avg(F.when(F.col("r") <= k, F.col("off"))).alias("top"))


def zero_cells(shares: DataFrame, links: int) -> DataFrame:
    """(slot, zero_links, fraction): links of a slot without a positive share, of ``links`` in all."""
    zero = F.lit(links) - F.count_if(F.col("p") > 0)
    return shares.groupBy("slot").agg(zero.alias("zero_links"), (zero / links).alias("fraction"))


def zeros_distribution(shares: DataFrame, cells: int, weeks: int = 4) -> DataFrame:
    """(zeros, n): how many of ``cells`` pairs of bow and link are zero in 0 to ``weeks`` weeks; cells that never occur are zero in all."""
    seen = shares.where("p > 0").groupBy("bow", "link_id").agg((weeks - F.count("*")).alias("zeros")).groupBy("zeros").agg(F.count("*").alias("n"))
    spine = shares.sparkSession.range(weeks + 1).select(F.col("id").alias("zeros"))
    found = spine.join(seen, "zeros", "left").select("zeros", F.coalesce("n", F.lit(0)).alias("n"))
    never = F.lit(cells) - F.sum("n").over(W.partitionBy())  # five rows
    return found.select("zeros", (F.col("n") + F.when(F.col("zeros") == weeks, never).otherwise(0)).alias("n"))


def variance_retained(raw: DataFrame, smooth: DataFrame, links: int, every: int = 10) -> DataFrame:
    """Mean variance over all ``links`` of every tenth slot that varies, smooth against raw; absent links count as zeros."""

    def mean(rows: DataFrame) -> DataFrame:
        by = rows.where(F.pmod(F.col("slot"), F.lit(every)) == 0).groupBy("slot").agg(F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("q"))
        var = F.col("q") / links - F.pow(F.col("s") / links, 2)
        return by.select(var.alias("var")).where("var > 0").agg(F.avg("var").alias("var"))

    return mean(smooth).crossJoin(mean(raw).withColumnRenamed("var", "raw")).select(F.coalesce(F.try_divide("var", "raw"), F.lit(0.0)).alias("retained"))


def displacement_stats(cells: DataFrame, floor: float, at: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """One row: quantiles of displacements (d) by a noise floor, their mean, and the share above one half."""
    ratio = cells.select((F.col("d") / floor).alias("ratio"))
    q = quantiles(ratio, "ratio", list(at))
    return ratio.agg(*(F.lit(x).alias(f"p{round(100 * a)}") for a, x in zip(at, q, strict=True)), F.avg("ratio").alias("mean"), F.avg((F.col("ratio") > 0.5).cast("double")).alias("above_half"))


def band_medians(cells: DataFrame) -> DataFrame:
    """Per gamma and band of cells (gamma, band, mean, std, smooth_mean, smooth_std, d): size and medians; EMPTY has no ratio to std."""
    ratio = F.when(F.col("band") != "EMPTY", F.col("d") / F.greatest(F.col("std"), F.lit(1e-12)))
    cells, values = cells.withColumn("ratio", ratio), ["mean", "std", "smooth_mean", "smooth_std", "d", "ratio"]
    half = grouped_quantiles(cells, ["gamma", "band"], values, [0.5])
    size = cells.groupBy("gamma", "band").agg(F.count("*").alias("n"))
    same = size["gamma"].eqNullSafe(half["gamma"]) & size["band"].eqNullSafe(half["band"])
    return size.join(half, same).select(size["gamma"], size["band"], "n", *(F.col(v)[0].alias(f"med_{v}") for v in values))


def nearest(rows: DataFrame, value: str, target: float) -> DataFrame:
    """The row whose ``value`` is nearest to ``target``; of two the smaller."""
    return rows.agg(F.min_by(F.struct(*rows.columns), F.struct(F.abs(F.col(value) - target), F.col(value))).alias("r")).select("r.*")


def best(rows: DataFrame, score: str, by: str, key: list[str] | None = None) -> DataFrame:
    """The row with the least ``score`` (for each ``key``); the first by ``by`` if several have it."""
    return rows.groupBy(*(key or [])).agg(F.min_by(F.struct(*rows.columns), F.struct(score, by)).alias("r")).select("r.*")


def sigma_table(runs: DataFrame) -> DataFrame:
    """Runs by declared sigma with the gap to the measured one and a verdict; the smallest declared sigma above it is chosen."""
    rows = runs.withColumn("gap", F.col("measured") - F.col("declared"))
    rows = rows.withColumn("chosen", F.coalesce(F.col("declared") == F.min(F.when(F.col("gap") < 0, F.col("declared"))).over(W.partitionBy()), F.lit(False)))
    return rows.withColumn("verdict", F.when(F.col("chosen"), "chosen").when(F.col("gap") > 0.5, "too tight").when(F.col("gap") > 0, "slightly too tight").otherwise("too loose"))
