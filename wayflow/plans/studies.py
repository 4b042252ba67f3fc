"""Further named queries: converged chains, fits, sweeps, reports, matching, scans and sinks.  Importing registers them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from wayflow.functions import calendar
from wayflow.operators import chain, graph, matching, network, stats, sweeps, trips
from wayflow.plans.catalog import _CHAIN, _PRIOR, _Q, BOX, CLOSED, X, _checkpointed, _counts, _fixed, _phase, _prior, _query, _r, _shares, _sr, _v, _weighted
from wayflow.plans.catalog import _S as SQLS
from wayflow.sources import files, sinks

D = "CAST({} AS DOUBLE)".format
TOL = 1e-13
UP, DOWN, SP = (4.6489, 1.1607), (-0.5722, -0.1673), (1.7513, 0.4358)


def _workspace(s: SparkSession) -> str:
    """A new path in the shared folder."""
    _checkpointed(s)
    return f"{s.sparkContext.getCheckpointDir() or tempfile.gettempdir()}/scan-{uuid.uuid4().hex}"


def _kernel_sql(name: str, powers: tuple[float, float], where: str = "true") -> str:
    w = f"SELECT link_id, (speed / (SELECT avg(speed) FROM links)) ** {D(powers[0])} * (lanes / (SELECT avg(lanes) FROM links)) ** {D(powers[1])} AS w FROM links"
    return f"{name} AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS p FROM adjacency JOIN ({w}) ON dst = link_id WHERE {where})"


def _kernel(s: SparkSession, powers: tuple[float, float], adjacency: DataFrame | None = None) -> DataFrame:
    return graph.kernel(X.adjacency(s) if adjacency is None else adjacency, graph.weights(X.links(s), *powers))


def _walk(name: str, prior: str, kernel: str, steps: int, kind: str = "single", to_prior: bool = False, key: str = "slot") -> str:
    """A recursive query for the single-phase or the damped chain: rows (k, key, link_id, v) of every step k."""
    into = "coalesce(sum(s.v * e.p), 0)"
    keep = ", ".join(f"p.{c}" for c in key.split(", "))
    same = " AND ".join(f"s.{c} = p.{c}" for c in key.split(", "))
    if kind == "damped":
        body, v = f"{D(0.8)} * {into} + (1 - {D(0.8)}) * any_value(p.p)", "v"
    else:
        body, v = f"{D(0.0508)} * any_value(p.p) + (1 - {D(0.0508)}) * {into}", f"v / sum(v) OVER (PARTITION BY {key})"
    if to_prior:
        kernel = f"(SELECT * FROM {kernel} UNION ALL SELECT * FROM dangling)"
    return f"{name} AS (SELECT 0 AS k, {key}, link_id, p AS v FROM {prior} UNION ALL SELECT k, {key}, link_id, {v} AS v FROM (SELECT max(max(s.k)) OVER () + 1 AS k, {keep}, p.link_id, {body} AS v FROM {prior} p LEFT JOIN {kernel} e ON e.dst = p.link_id LEFT JOIN {name} s ON {same} AND s.link_id = e.src GROUP BY {keep}, p.link_id) WHERE k <= {steps})"


def _walk_two(name: str, prior: str, up: str, down: str, steps: int, key: str = "slot", dangling: str | None = None) -> str:
    """The same for the two-phase chain: rows (k, key, link_id, u, d)."""
    lost = ", ".join(f"sum(CASE WHEN link_id IN ({dangling}) THEN {c} ELSE 0 END) OVER (PARTITION BY {key}) AS lost_{c}" for c in "ud") if dangling else "0 AS lost_u, 0 AS lost_d"
    keep = ", ".join(f"p.{c}" for c in key.split(", "))
    sames = lambda t: " AND ".join(f"{t}.{c} = p.{c}" for c in key.split(", "))
    push = lambda t, e: f"(SELECT {key}, e.dst AS link_id, sum(now.{t} * e.p) AS v FROM now JOIN {e} e ON now.link_id = e.src GROUP BY ALL)"
    return (
        f"{name} AS (SELECT 0 AS k, {key}, link_id, p AS u, {D(0)} AS d FROM {prior} UNION ALL (WITH now AS (SELECT *, sum(d) OVER (PARTITION BY {key}) AS back, {lost} FROM {name}), "
        f"new AS (SELECT now.k + 1 AS k, {keep}, p.link_id, (1 - {D(0.102)}) * (coalesce(mu.v, 0) + lost_u * p.p) + {D(0.101)} * p.p * back AS u, {D(0.102)} * now.u + (1 - {D(0.101)}) * (coalesce(md.v, 0) + lost_d * p.p) AS d "
        f"FROM {prior} p JOIN now ON {sames('now')} AND now.link_id = p.link_id LEFT JOIN {push('u', up)} mu ON {sames('mu')} AND mu.link_id = p.link_id LEFT JOIN {push('d', down)} md ON {sames('md')} AND md.link_id = p.link_id) "
        f"SELECT k, {key}, link_id, u / sum(u + d) OVER (PARTITION BY {key}) AS u, d / sum(u + d) OVER (PARTITION BY {key}) AS d FROM new WHERE k <= {steps}))"
    )


def _converged(s: SparkSession, d: str, model: chain.Model, *kernels: DataFrame) -> DataFrame:
    _checkpointed(s)
    return chain.stationary(_prior(s, d), list(kernels) or [_weighted(s)], model, tol=TOL, max_iter=1000).select("slot", "link_id", "v")


X.SQL |= {
    "up": _kernel_sql("up", UP),
    "down": _kernel_sql("down", DOWN),
    "walk": _walk("walk", "prior", "kernel", 600),
    "walkd": _walk("walkd", "prior", "kernel", 120, "damped"),
    "walk2": _walk_two("walk2", "prior", "up", "down", 400),
    "walk23": _walk_two("walk23", "prior", "up", "down", 3),
    "walkp": _walk_two("walkp", "prior", "kernel", "kernel", 3, dangling="SELECT i FROM range(100) t(i) WHERE i % 17 = 0"),
}
_PAIR = (*_PRIOR, "adjacency", "up", "down")


@_query(f"SELECT slot, link_id, {_sr('v', '1e6', 3)} AS v_ppm FROM walk WHERE k = 600", *_CHAIN, "walk")
def sp_chain(s, d):
    return _v3(_converged(s, d, chain.Model()))


def _v3(df: DataFrame) -> DataFrame:
    return df.select("slot", "link_id", _r(F.col("v"), 1e6, 3).alias("v_ppm"))


@_query(f"SELECT slot, link_id, {_sr('v', '1e6', 3)} AS v_ppm FROM walkd WHERE k = 120", *_CHAIN, "walkd")
def pagerank_damped(s, d):
    return _v3(_converged(s, d, chain.Model("damped")))


@_query(f"SELECT slot, link_id, {_sr('u + d', '1e6', 3)} AS v_ppm FROM walk2 WHERE k = 400", *_PAIR, "walk2")
def tp_chain(s, d):
    return _v3(_converged(s, d, chain.Model("two"), _kernel(s, UP), _kernel(s, DOWN)))


@_query(f"SELECT slot, link_id, {_sr('u + d')} AS v_ppm FROM walk23 WHERE k = 3", *_PAIR, "walk23")
def tp_updown_chain_k(s, d):
    return _v(_fixed(s, d, chain.Model("two"), _kernel(s, UP), _kernel(s, DOWN)))


@_query(f"SELECT slot, link_id, {_sr('u + d')} AS v_ppm FROM walkp WHERE k = 3", *_CHAIN, "walkp")
def tp_chain_dangling_k(s, d):
    return _v(_fixed(s, d, chain.Model("two", to_prior=True)))


@_query(f"SELECT slot, link_id, {_sr('v')} AS v_ppm FROM s3", *_CHAIN, "sp")
def sp_chain_relational_k(s, d):
    """The chain as joins, which serves kernels that are too large to broadcast."""
    _checkpointed(s)
    return _v(chain.relational(_prior(s, d), [_weighted(s)], chain.Model(), 0.0, 3))


@_query("SELECT walk.slot, round(avg(abs(p - v) / (p + CAST(1e-6 AS DOUBLE))), 6) AS mre FROM walk JOIN prior USING (slot, link_id) WHERE k = 600 GROUP BY walk.slot", *_CHAIN, "walk")
def mre_by_slot(s, d):
    return stats.relative_error(_converged(s, d, chain.Model()), _prior(s, d)).select("slot", F.round("mre", 6).alias("mre"))


X.SQL["flat"] = "flat AS (SELECT 0 AS slot, link_id, 1.0 / (SELECT count(*) FROM links) AS p FROM links)"
X.SQL["walkf"] = _walk("walkf", "flat", "kernel", 600)


@_query("SELECT p.slot, round(avg(abs(p.p - v) / (p.p + CAST(1e-6 AS DOUBLE))), 6) AS mre FROM prior p JOIN walkf USING (link_id) WHERE k = 600 GROUP BY p.slot", *_CHAIN, "flat", "walkf")
def uniform_baseline(s, d):
    _checkpointed(s)
    return chain.baseline_errors(_prior(s, d), [_weighted(s)], X.links(s), tol=TOL, max_iter=1000).select("slot", F.round("mre", 6).alias("mre"))


X.SQL["turned"] = "turned AS (SELECT a.src, a.dst, coalesce(greatest(-1, least(1, ((l1.lon2 - l1.lon1) * (l2.lon2 - l2.lon1) + (l1.lat2 - l1.lat1) * (l2.lat2 - l2.lat1)) / nullif(sqrt((l1.lon2 - l1.lon1) ** 2 + (l1.lat2 - l1.lat1) ** 2) * sqrt((l2.lon2 - l2.lon1) ** 2 + (l2.lat2 - l2.lat1) ** 2), 0))), 0) AS turn FROM adjacency a JOIN links l1 ON a.src = l1.link_id JOIN links l2 ON a.dst = l2.link_id)"


@_query(f"SELECT src, dst, {_sr('f / sum(f) OVER (PARTITION BY src)')} AS p_ppm FROM (SELECT src, dst, w * greatest(1 + turn + {D(0.01)}, 0) ** {D(0.5)} AS f FROM turned JOIN weights ON dst = link_id)", "streets", "passes", "weights", "turned")
def turn_angle_kernel(s, d):
    k = graph.angle_kernel(graph.turns(X.passes(s, d), X.streets(s, d), still=1.0), graph.weights(X.streets(s, d), *SP), 0.5, 0.01)
    return k.select("src", "dst", _r(F.col("p")).alias("p_ppm"))


# Priors without a dense table


@_query(f"SELECT slot, link_id, {_sr('c / sum(c) OVER (PARTITION BY slot)')} AS p_ppm FROM mixed", *_PRIOR, "adjacency", "diffused")
def smoothed_sparse(s, d):
    """The diffused prior from sparse counts and two constants, unfolded to all links only for the comparison."""
    c, links, k = _counts(s, d), X.links(s), graph.kernel(X.adjacency(s))
    rows = graph.smoothed(c, links, k)
    alive = k.select(F.col("src").alias("link_id")).distinct().withColumn("alive", F.lit(True))
    rest = rows.groupBy("slot").agg(F.first("p_link").alias("p_link"), F.first("p_dead").alias("p_dead"))
    spine = rest.crossJoin(F.broadcast(links.select("link_id").join(alive, "link_id", "left")))
    full = spine.join(rows.select("slot", "link_id", "p"), ["slot", "link_id"], "left")
    return full.select("slot", "link_id", _r(F.coalesce("p", F.when(F.col("alive"), F.col("p_link")).otherwise(F.col("p_dead")))).alias("p_ppm"))


@_query("SELECT us // 86400000000 AS slot, link_id, arg_max(did, seq) AS c FROM pings WHERE link_id IN (SELECT link_id FROM links) GROUP BY ALL", "pings", "links")
def project_last(s, d):
    """Cells that come again: the last one stands."""
    cells = X.pings(s, d).select(F.floor(F.col("us") / 86_400_000_000).alias("slot"), "link_id", F.col("did").alias("c"), "seq")
    return graph.project(cells, X.links(s), "seq")


@_query("SELECT slot, link_id, CAST(sum(c) AS DOUBLE) AS c FROM (SELECT slot, link_id % 90 + 20 AS link_id, c FROM counts) WHERE link_id < 100 GROUP BY ALL", "pings", "counts")
def project_counts(s, d):
    return graph.project(_counts(s, d).withColumn("link_id", F.col("link_id") % 90 + 20), X.links(s)).select("slot", "link_id", "c")


@_query("SELECT slot, link_id, coalesce(c, 0) AS c FROM (SELECT (SELECT min(slot) FROM counts) + i AS slot FROM range(-2, 4) t(i)) LEFT JOIN counts USING (slot)", "pings", "counts")
def slot_lookup(s, d):
    c = _counts(s, d)
    return graph.at_slots(c, c.agg(F.min("slot").alias("m")).select(F.explode(F.sequence(F.col("m") - 2, F.col("m") + 3)).alias("slot")))


@_query(f"SELECT slot, link_id, {_sr('c / sum(c) OVER (PARTITION BY slot)')} AS p_ppm FROM counts WHERE slot BETWEEN 17545 AND 20000", "pings", "counts")
def time_range(s, d):
    return graph.between(_counts(s, d), 17545, 20000).select("slot", "link_id", _r(F.col("c")).alias("p_ppm"))


@_query("SELECT slot, link_id, CASE WHEN s > 0 THEN round(z / s, 9) ELSE round(1.0 / n, 9) END AS p FROM (SELECT slot, link_id, z, sum(z) OVER (PARTITION BY slot) AS s, count(*) OVER (PARTITION BY slot) AS n FROM (SELECT slot, link_id, CASE WHEN slot % 3 = 0 THEN 0 ELSE c END AS z FROM counts))", "pings", "counts")
def uniform_fallback(s, d):
    z = _counts(s, d).withColumn("c", F.when(F.col("slot") % 3 == 0, 0.0).otherwise(F.col("c")))
    return graph.normalize(z, "c", empty="uniform").select("slot", "link_id", F.round("c", 9).alias("p"))


@_query(f"SELECT a.slot, link_id, {_sr('a.p')} AS p_ppm, {_sr('b.p')} AS q_ppm FROM prior a JOIN (SELECT slot - 7 AS slot, link_id, p FROM prior) b USING (slot, link_id)", *_PRIOR)
def week_alignment(s, d):
    p = _prior(s, d)
    return p.join(graph.next_week(p, "p", 7), ["slot", "link_id"]).select("slot", "link_id", _r(F.col("p")).alias("p_ppm"), _r(F.col("q")).alias("q_ppm"))


# Trips


@_query("SELECT did, seq FROM pings WHERE lat IS NOT NULL AND lon IS NOT NULL", "pings")
def valid_pings(s, d):
    return trips.valid(X.pings(s, d)).select("did", "seq")


_TRIPS = "numbered AS (SELECT *, count(*) OVER (PARTITION BY did, trip) AS n FROM trips)"
X.SQL["numbered"] = _TRIPS


def _numbered(s, d):
    return trips.trip_ids(trips.sessionize(X.pings(s, d), 86400))


@_query("SELECT count(DISTINCT (did, trip)) AS trips, 1 AS first, count(DISTINCT (did, trip)) AS last, count(*) AS pings FROM trips", "pings", "trips")
def trip_ids(s, d):
    return _numbered(s, d).agg(F.count_distinct("route_id").alias("trips"), F.min("route_id").cast("int").alias("first"), F.max("route_id").alias("last"), F.count("*").alias("pings"))


@_query("SELECT did, seq FROM numbered WHERE n >= 5", "pings", "trips", "numbered")
def min_fixes(s, d):
    return trips.long_enough(_numbered(s, d), 5).select("did", "seq")


@_query("SELECT route_id, fix_idx, link_id FROM fixes WHERE route_id IN (SELECT route_id FROM fixes GROUP BY route_id HAVING count(DISTINCT link_id) >= 3)", "fixes")
def min_links(s, d):
    return trips.wide_enough(X.fixes(s, d), 3).select("route_id", "fix_idx", "link_id")


@_query("SELECT part, count(*) AS fixes FROM (SELECT route_id % 4 AS part FROM fixes) GROUP BY ALL", "fixes")
def hash_shards(s, d):
    f = X.fixes(s, d)
    out = [trips.shard(f, k, 4).agg(F.count("*").alias("fixes")).select(F.lit(k).cast("long").alias("part"), "fixes") for k in range(4)]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@_query("SELECT route_id, k, CASE WHEN k >= 3 THEN l_up ELSE 0 END AS l_up FROM (SELECT route_id, pos AS l_up, k FROM scored QUALIFY row_number() OVER (PARTITION BY route_id ORDER BY score DESC, abs(pos - (k - 1) / 2.0), pos) = 1)", "links", "fixes", "path", "phase")
def phase_split_all(s, d):
    return trips.phase_split(trips.distinct_path(X.fixes(s, d)), X.links(s), all_trips=True).select("route_id", "k", "l_up")


X.SQL["means"] = "means AS (SELECT route_id, count(*) AS k, avg(speed) AS avg_speed, avg(lanes) AS avg_lanes FROM path JOIN links USING (link_id) GROUP BY route_id HAVING count(*) >= 3)"


@_query("SELECT b.bin, coalesce(n, 0) AS n, round(coalesce(speed, 0), 6) AS speed, round(coalesce(lanes, 0), 6) AS lanes FROM (SELECT unnest(range(20)) AS bin) b LEFT JOIN (SELECT least(floor((k - 3) / (((SELECT max(k) FROM means) - 3) / CAST(20 AS DOUBLE))), 19) AS bin, count(*) AS n, avg(avg_speed) AS speed, avg(avg_lanes) AS lanes FROM means GROUP BY ALL) m ON m.bin = b.bin", "links", "fixes", "path", "means")
def phase_bins(s, d):
    return trips.binned_means(_phase(s, d)).select("bin", "n", F.round("speed", 6).alias("speed"), F.round("lanes", 6).alias("lanes"))


@_query("SELECT count(DISTINCT route_id) AS trips FROM fixes", "fixes")
def trip_count(s, d):
    return X.fixes(s, d).agg(F.count_distinct("route_id").alias("trips"))


@_query("SELECT link_id, count(DISTINCT route_id) AS n FROM fixes GROUP BY ALL", "fixes")
def trips_per_link(s, d):
    return network.trips_per_link(X.fixes(s, d))


@_query("SELECT link_id, row_number() OVER (ORDER BY CAST(link_id AS VARCHAR)) - 1 AS idx FROM (SELECT DISTINCT link_id FROM counts)", "pings", "counts")
def sorted_axis(s, d):
    return graph.axis(_counts(s, d).select(F.col("link_id").cast("string").alias("link_id"))).select(F.col("link_id").cast("long").alias("link_id"), "idx")


# Fits


@_query("SELECT round(1 / (1 + avg(l_up)), 9) AS beta, round(1 / (1 + avg(l_down)), 9) AS rho FROM phase", "links", "fixes", "path", "phase")
def phase_rates(s, d):
    return stats.phase_rates(_phase(s, d)).select(F.round("beta", 9).alias("beta"), F.round("rho", 9).alias("rho"))


def _chi2_sql(column: str, name: str) -> str:
    """Greedy pooling from 0 upwards as a recursion over lengths."""
    return (
        f"{name}_t AS (SELECT CAST(count(*) AS DOUBLE) AS n, 1 / (1 + avg({column})) AS p, max({column}) AS last FROM phase), "
        f"{name}_c AS (SELECT k, CAST(coalesce(o, 0) AS DOUBLE) AS o, (1 - p) ** k * p * n AS e FROM (SELECT unnest(range((SELECT last FROM {name}_t) + 1)) AS k) LEFT JOIN (SELECT {column} AS k, count(*) AS o FROM phase GROUP BY ALL) USING (k), {name}_t), "
        f"{name}_r AS (SELECT k, o AS ao, e AS ae, 0 AS bin FROM {name}_c WHERE k = 0 UNION ALL SELECT c.k, CASE WHEN ae >= 5 THEN c.o ELSE ao + c.o END, CASE WHEN ae >= 5 THEN c.e ELSE ae + c.e END, CASE WHEN ae >= 5 THEN bin + 1 ELSE bin END FROM {name}_r r JOIN {name}_c c ON c.k = r.k + 1), "
        f"{name}_b AS (SELECT bin, arg_max(ao, k) AS o, arg_max(ae, k) AS e, max(k) AS k FROM {name}_r GROUP BY bin), "
        f"{name}_l AS (SELECT n - (SELECT sum(e) FROM {name}_c) AS tail, last FROM {name}_t), "
        f"{name}_f AS (SELECT o, e FROM {name}_b, {name}_l WHERE k < last OR e >= 5 UNION ALL SELECT coalesce(any_value(o) FILTER (k = last AND e < 5), 0), any_value(tail) + coalesce(any_value(e) FILTER (k = last AND e < 5), 0) FROM {name}_b, {name}_l), "
        f"{name} AS (SELECT sum((o - e * z) ** 2 / (e * z)) AS chi2, greatest(count(*) - 2, 1) AS dof, count(*) AS bins FROM {name}_f, (SELECT sum(o) / sum(e) AS z FROM {name}_f) WHERE e > 0)"
    )


X.SQL |= {"chi_up": _chi2_sql("l_up", "chi_up")}


@_query("SELECT round(chi2, 4) AS chi2, CAST(dof AS INT) AS dof, round(chi2 / dof, 4) AS chi2_per_dof, CAST(bins AS INT) AS bins FROM chi_up", "links", "fixes", "path", "phase", "chi_up")
def chi2_geom(s, d):
    c = stats.chi2_geometric(_phase(s, d), "l_up")
    return c.select(F.round("chi2", 4).alias("chi2"), "dof", F.round("chi2_per_dof", 4).alias("chi2_per_dof"), "bins")


def _ks_sql(column: str) -> str:
    return f"(SELECT max(abs(e - (1 - (1 - p) ** (k + 1)))) FROM (SELECT k, (SELECT 1 / (1 + avg({column})) FROM phase) AS p, (SELECT count(*) FROM phase WHERE {column} <= t.k) / (SELECT count(*) FROM phase) AS e FROM (SELECT unnest(range((SELECT max({column}) FROM phase) + 2)) AS k) t))"


@_query(f"SELECT round(single, 6) AS ks_single, round(u, 6) AS ks_up, round(w, 6) AS ks_down, round((u + w) / 2, 6) AS ks_split, round(100 * (single - (u + w) / 2) / single, 4) AS ks_improvement FROM (SELECT {_ks_sql('(l_up + l_down + 1)')} AS single, {_ks_sql('l_up')} AS u, {_ks_sql('l_down')} AS w)", "links", "fixes", "path", "phase")
def fit_comparison(s, d):
    c = stats.compare_fits({"lineitem": _phase(s, d)})
    return c.select(*(F.round(f"ks_{x}", 6).alias(f"ks_{x}") for x in ("single", "up", "down", "split")), F.round("ks_improvement", 4).alias("ks_improvement"))


@_query("SELECT " + ", ".join(f"round(quantile_cont(d, {q}), 6) AS p{str(q)[2:]}" for q in (0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 0.999)) + ", (SELECT round(avg(d), 6) FROM residuals) AS mean_all, (SELECT round(100.0 * count(*) FILTER (d > 30) / count(*), 6) FROM residuals) AS dropped_pct FROM residuals WHERE d <= 30", "residuals")
def residual_percentiles(s, d):
    r = stats.robust(X.residuals(s, d))
    names = [str(q)[2:] for q in (0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 0.999)]
    return r.select(*(F.round(F.col("percentiles")[k], 6).alias(f"p{n}") for k, n in enumerate(names)), F.round("mean_all", 6).alias("mean_all"), F.round("dropped_pct", 6).alias("dropped_pct"))


@_query("SELECT CAST(least(floor(log10(greatest(1, least(60, d))) / (log10(60) / 12)), 11) AS INT) AS bin, count(*) AS n FROM (SELECT d + 0.003 AS d FROM residuals) GROUP BY ALL", "residuals")
def residual_log_bins(s, d):
    return stats.log_bins(X.residuals(s, d).select((F.col("d") + 0.003).alias("d")), "d", 1.0, 60.0, 12)


# Noise, displacement, sweeps


@_query("SELECT slot, 100 - count(*) AS zero_links, round((100 - count(*)) / 100, 9) AS fraction FROM counts GROUP BY slot", "pings", "counts")
def zero_fractions(s, d):
    return stats.zero_cells(_counts(s, d).withColumnRenamed("c", "p"), 100).select("slot", "zero_links", F.round("fraction", 9).alias("fraction"))


@_query("SELECT z AS zeros, (SELECT count(*) FROM (SELECT 4 - count(*) AS zeros FROM shares GROUP BY bow, link_id) WHERE zeros = z) + CASE WHEN z = 4 THEN 700 - (SELECT count(DISTINCT (bow, link_id)) FROM shares) ELSE 0 END AS n FROM range(5) t(z)", "pings", "counts", "shares")
def zeros_distribution(s, d):
    return stats.zeros_distribution(_shares(s, d), 700)


X.SQL["smooth"] = "smooth AS (SELECT slot, link_id, c / sum(c) OVER (PARTITION BY slot) AS p FROM mixed)"


@_query("SELECT round((SELECT avg(v) FROM (SELECT var_pop(p) AS v FROM smooth WHERE slot % 2 = 0 GROUP BY slot) WHERE v > 0) / (SELECT avg(v) FROM (SELECT sum(p * p) / 100 - (sum(p) / 100) ** 2 AS v FROM (SELECT slot, c / sum(c) OVER (PARTITION BY slot) AS p FROM counts) WHERE slot % 2 = 0 GROUP BY slot) WHERE v > 0), 6) AS retained", *_PRIOR, "adjacency", "diffused", "smooth")
def variance_retained(s, d):
    c = _counts(s, d)
    smooth = graph.diffuse(graph.laplace(c, X.links(s)), graph.kernel(X.adjacency(s)))
    return stats.variance_retained(graph.normalize(c, "c").withColumnRenamed("c", "p"), smooth, 100, 2).select(F.round("retained", 6).alias("retained"))


X.SQL |= {
    "grid": f"grid AS (SELECT unnest([{D(0)}, {D(0.1)}, {D(0.2)}, {D(0.5)}]) AS gamma)",
    "terms": "terms AS (SELECT d.slot, d.link_id, d.c AS a, coalesce(m, 0) AS pa FROM dense d LEFT JOIN (SELECT slot, src AS link_id, sum(c / deg) AS m FROM dense JOIN (SELECT *, count(*) OVER (PARTITION BY src) AS deg FROM adjacency) ON link_id = dst GROUP BY ALL) USING (slot, link_id))",
    "by_gamma": "by_gamma AS (SELECT gamma, slot, slot - (SELECT min(slot) FROM counts) AS i, link_id, ((1 - gamma) * a + gamma * pa) / sum((1 - gamma) * a + gamma * pa) OVER (PARTITION BY gamma, slot) AS p FROM terms, grid)",
    "in_weeks": "in_weeks AS (SELECT gamma, slot, link_id, p, i // 7 AS w, i % 7 AS bow FROM by_gamma WHERE i < 28)",
    "predicted": "predicted AS (SELECT b.gamma, '1w_next' AS kind, b.slot, b.link_id, b.p, a.p AS v FROM in_weeks a JOIN in_weeks b ON a.gamma = b.gamma AND a.link_id = b.link_id AND a.bow = b.bow AND b.w = a.w + 1 "
    "UNION ALL SELECT b.gamma, '2w_avg_to_next', b.slot, b.link_id, b.p, (x.p + y.p) / 2 FROM in_weeks x JOIN in_weeks y USING (gamma, link_id, bow) JOIN in_weeks b USING (gamma, link_id, bow) WHERE x.w = 0 AND y.w = 1 AND b.w = 2 "
    "UNION ALL SELECT b.gamma, '3w_avg_to_next', b.slot, b.link_id, b.p, (x.p + y.p + z.p) / 3 FROM in_weeks x JOIN in_weeks y USING (gamma, link_id, bow) JOIN in_weeks z USING (gamma, link_id, bow) JOIN in_weeks b USING (gamma, link_id, bow) WHERE x.w = 0 AND y.w = 1 AND z.w = 2 AND b.w = 3), "
    "kinds AS (SELECT * FROM predicted UNION ALL SELECT gamma, CASE WHEN (slot - (SELECT min(slot) FROM counts)) % 7 < 5 THEN 'weekday_1w' ELSE 'weekend_1w' END, slot, link_id, p, v FROM predicted WHERE kind = '1w_next' UNION ALL SELECT gamma, 'dow' || CAST((slot - (SELECT min(slot) FROM counts)) % 7 AS VARCHAR) || '_1w', slot, link_id, p, v FROM predicted WHERE kind = '1w_next')",
    "swept": "offs AS (SELECT gamma, kind, slot, abs(p - v) / (p + CAST(1e-6 AS DOUBLE)) AS o, row_number() OVER (PARTITION BY gamma, kind, slot ORDER BY round(p * CAST(1e12 AS DOUBLE)) DESC, link_id) AS r FROM kinds), swept AS (SELECT gamma, kind, count(*) AS n, avg(t) AS top_mean, avg(o) AS overall_mean, quantile_cont(o, 0.5) AS overall_median FROM (SELECT gamma, kind, slot, avg(o) AS o, avg(o) FILTER (r <= 10) AS t FROM offs GROUP BY ALL) GROUP BY ALL)",
}
_SWEEP = (*_PRIOR, "adjacency", "grid", "terms", "by_gamma", "in_weeks", "predicted", "swept")
GAMMAS = [0.0, 0.1, 0.2, 0.5]


def _smooth(s, d):
    terms = sweeps.smoothing_terms(_counts(s, d), X.links(s), graph.kernel(X.adjacency(s)))
    first = terms.agg(F.min("slot").alias("first"))
    return sweeps.smoothed_by_gamma(terms, GAMMAS).crossJoin(F.broadcast(first))


def _swept(s, d):
    smooth = _smooth(s, d)
    pairs = sweeps.cross_week_predictions(smooth, F.col("first"), 7)
    return sweeps.prediction_errors(pairs.withColumn("p", F.col("p")), 10)


@_query("SELECT gamma, kind, n, round(overall_mean, 6) AS overall_mean, round(overall_median, 6) AS overall_median FROM swept", *_SWEEP)
def gamma_sweep(s, d):
    return _swept(s, d).select("gamma", "kind", "n", F.round("overall_mean", 6).alias("overall_mean"), F.round("overall_median", 6).alias("overall_median"))


@_query("SELECT kind, arg_min(gamma, (round(overall_mean, 9), gamma)) AS gamma FROM swept GROUP BY kind", *_SWEEP)
def gamma_best(s, d):
    return stats.best(_swept(s, d).withColumn("score", F.round("overall_mean", 9)), "score", "gamma", ["kind"]).select("kind", "gamma")


@_query("SELECT gamma, kind FROM swept ORDER BY abs(round(overall_mean, 9) - 1), round(overall_mean, 9) LIMIT 1", *_SWEEP)
def gamma_nearest(s, d):
    """The swept gamma and kind of prediction whose error is nearest to the truth itself."""
    return stats.nearest(_swept(s, d).withColumn("score", F.round("overall_mean", 9)), "score", 1.0).select("gamma", "kind")


@_query(f"SELECT alpha, {_sr('avg(abs(p - q))')} AS moved FROM (SELECT alpha, slot, link_id, (c - {D(0.01)} + alpha) / sum(c - {D(0.01)} + alpha) OVER (PARTITION BY alpha, slot) AS p FROM dense, (SELECT unnest([{D(0.001)}, {D(0.01)}, {D(0.1)}, {D(1)}]) AS alpha)) JOIN (SELECT slot, link_id, (c - {D(0.01)}) / sum(c - {D(0.01)}) OVER (PARTITION BY slot) AS q FROM dense) USING (slot, link_id) GROUP BY alpha", *_PRIOR)
def alpha_sweep(s, d):
    """How far Laplace smoothing of each strength moves the shares."""
    dense = graph.laplace(_counts(s, d), X.links(s), 0.0).withColumnRenamed("c", "raw")
    rows = dense.select("*", F.explode(F.array(*map(F.lit, (0.001, 0.01, 0.1, 1.0)))).alias("alpha")).withColumn("key", F.struct("alpha", "slot"))
    p = graph.normalize(graph.normalize(rows.withColumn("c", F.col("raw") + F.col("alpha")), "c", "key"), "raw", "key")
    return p.groupBy("alpha").agg(F.avg(F.abs(F.col("c") - F.col("raw"))).alias("m")).select("alpha", _r(F.col("m")).alias("moved"))


X.SQL["moved"] = "raw AS (SELECT slot, link_id, c / sum(c) OVER (PARTITION BY slot) AS q FROM counts), moved AS (SELECT gamma, i % 7 AS bow, link_id, sum(abs(p - coalesce(q, 0))) / 4 AS d, sum(coalesce(q, 0)) / 4 AS mean, stddev_samp(coalesce(q, 0)) AS std, avg(p) AS smooth_mean, stddev_samp(p) AS smooth_std FROM by_gamma LEFT JOIN raw USING (slot, link_id) WHERE i < 28 GROUP BY ALL)"
_MOVED = (*_PRIOR, "adjacency", "grid", "terms", "by_gamma", "moved")


def _moved(s, d):
    raw = graph.normalize(_counts(s, d), "c").withColumnRenamed("c", "p")
    return sweeps.smoothing_displacement(_smooth(s, d), raw, F.col("first"), 7)


@_query("SELECT round(quantile_cont(d / CAST(0.008 AS DOUBLE), 0.5), 6) AS p50, round(quantile_cont(d / CAST(0.008 AS DOUBLE), 0.95), 6) AS p95, round(quantile_cont(d / CAST(0.008 AS DOUBLE), 0.99), 6) AS p99, round(avg(d / CAST(0.008 AS DOUBLE)), 6) AS mean, round(avg(CAST(d / CAST(0.008 AS DOUBLE) > 0.5 AS INT)), 6) AS above_half FROM moved WHERE gamma = CAST(0.2 AS DOUBLE)", *_MOVED)
def displacement_stats(s, d):
    r = stats.displacement_stats(_moved(s, d).where("gamma = 0.2"), 0.008)
    return r.select(*(F.round(c, 6).alias(c) for c in r.columns))


@_query("SELECT gamma, band, count(*) AS n, " + ", ".join(f"round(quantile_cont({c}, 0.5) * 1000000, 3) AS med_{c}" for c in ("mean", "std", "smooth_mean", "smooth_std", "d")) + ", round(quantile_cont(CASE WHEN band <> 'EMPTY' THEN d / greatest(std, 1e-12) END, 0.5), 6) AS med_ratio FROM (SELECT *, CASE WHEN mean = 0 THEN 'EMPTY' WHEN std < 0.004 THEN 'SUBNOISE' WHEN std <= 0.016 THEN 'MIXED' ELSE 'SIGNAL' END AS band FROM moved) GROUP BY ALL", *_MOVED)
def band_medians(s, d):
    _checkpointed(s)
    m = stats.band_medians(network.noise_bands(_moved(s, d), 0.008))
    return m.select("gamma", "band", "n", *(_r(F.col(c), 1e6, 3).alias(c) for c in ("med_mean", "med_std", "med_smooth_mean", "med_smooth_std", "med_d")), F.round("med_ratio", 6).alias("med_ratio"))


@_query("SELECT slot, round(avg(o), 6) AS overall, round(avg(o) FILTER (r <= 10), 6) AS top FROM (SELECT b.slot, abs(b.c - a.c) / (b.c + CAST(1e-6 AS DOUBLE)) AS o, row_number() OVER (PARTITION BY b.slot ORDER BY b.c DESC, b.link_id) AS r FROM dense b JOIN dense a ON a.slot = b.slot - 7 AND a.link_id = b.link_id) GROUP BY slot", *_PRIOR)
def topk_mre(s, d):
    """Last week's smoothed counts against this week's."""
    dense = graph.laplace(_counts(s, d), X.links(s))
    before = dense.select((F.col("slot") + 7).alias("slot"), "link_id", F.col("c").alias("v"))
    return stats.top_error(before, dense.withColumnRenamed("c", "p"), 10).select("slot", F.round("overall", 6).alias("overall"), F.round("top", 6).alias("top"))


@_query(f"SELECT round(avg(abs(p.p - q.p)) * 1000000, 4) AS mae, round(avg((p.p - q.p) ** 2) * 1000000000000, 2) AS mse FROM prior p JOIN (SELECT slot + 7 AS slot, link_id, p FROM prior) q USING (slot, link_id) WHERE {BOX}", *_PRIOR)
def box_errors(s, d):
    p = _prior(s, d)
    before = p.select((F.col("slot") + 7).alias("slot"), "link_id", F.col("p").alias("v"))
    return stats.box_errors(before, p, F.expr(BOX)).select(F.round("mae", 4).alias("mae"), F.round("mse", 2).alias("mse"))


PSI = [k / 1000 for k in range(-12, 41)]
X.SQL |= {
    "psis": "psis AS (SELECT (i - 12) / CAST(1000 AS DOUBLE) AS psi FROM range(53) t(i))",
    "given": f"given AS (SELECT psi, slot, link_id, CASE WHEN {CLOSED} THEN p WHEN {BOX} THEN p * (1 + psi / b) ELSE p * (1 - psi / (1 - b)) END AS p FROM (SELECT *, sum(CASE WHEN {BOX} THEN p ELSE 0 END) OVER (PARTITION BY slot) AS b FROM prior), psis)",
    "walkpsi": _walk("walkpsi", "given", "kernel", 3, key="psi, slot"),
    "psi_off": f"psi_off AS (SELECT psi, w.slot, link_id, (q.p - v) ** 2 * 1000000000000 AS sq FROM walkpsi w JOIN (SELECT slot - 7 AS slot, link_id, p FROM prior) q USING (slot, link_id) WHERE k = 3 AND {BOX})",
}
_PSI = (*_CHAIN, "psis", "given", "walkpsi", "psi_off")


THREE = {"tol": 0.0, "max_iter": 3}


def _psi_errors(s, d, kernels=None, model=chain.Model(), **steps):
    _checkpointed(s)
    p = _prior(s, d)
    truth = p.select((F.col("slot") - 7).alias("slot"), "link_id", "p")
    return sweeps.psi_errors(p, truth, F.expr(BOX), PSI, kernels or [_weighted(s)], model, F.expr(CLOSED), **steps)


def _psi_mse(e):
    return e.groupBy("psi").agg(F.round(F.avg("sq"), 2).alias("mse"))


def _psi_best(e, **how):
    return sweeps.psi_fit(e, **how).select("part", "psi", *(F.round(c, 2).alias(c) for c in ("train", "test", "base")))


@_query("SELECT psi, round(avg(sq), 2) AS mse FROM psi_off GROUP BY psi", *_PSI)
def psi_chain_errors_k(s, d):
    return _psi_mse(_psi_errors(s, d, **THREE))


@_query("SELECT 0 AS part, psi, round(train, 2) AS train, round(test, 2) AS test, round((SELECT test FROM m WHERE abs(psi) < 1e-9), 2) AS base FROM m ORDER BY train, psi LIMIT 1", *_PSI)
def psi_grid_fit_k(s, d):
    return _psi_best(_psi_errors(s, d, **THREE), test=F.col("link_id") % 4 == 0)


SQLS["psi_grid_fit_k"] = SQLS["psi_grid_fit_k"].replace(" SELECT 0 AS part", ", m AS (SELECT psi, avg(sq) FILTER (link_id % 4 <> 0) AS train, avg(sq) FILTER (link_id % 4 = 0) AS test FROM psi_off GROUP BY psi) SELECT 0 AS part", 1)


def psi_chain_errors(s, d):
    """Converged chains for every psi; SQL would take hundreds of steps for each."""
    return _psi_mse(_psi_errors(s, d))


def psi_grid_fit(s, d):
    return _psi_best(_psi_errors(s, d), test=F.col("link_id") % 4 == 0)


def _psi_table(e):
    t = sweeps.psi_table(e, F.pmod(F.col("slot"), F.lit(7)), "bow")
    return t.select("bow", "whole", "psi", *(F.round(c, k).alias(c) for c, k in (("mae", 4), ("mse", 2), ("base_mae", 4), ("base_mse", 2))))


@_query(
    "SELECT bow, whole, arg_min(psi, (mse, psi)) AS psi, round(arg_min(mae, (mse, psi)), 4) AS mae, round(min(mse), 2) AS mse, round(max(mae) FILTER (abs(psi) < 1e-9), 4) AS base_mae, round(max(mse) FILTER (abs(psi) < 1e-9), 2) AS base_mse "
    "FROM (SELECT psi, bow, grouping(bow) = 1 AS whole, avg(sqrt(sq)) AS mae, avg(sq) AS mse FROM (SELECT *, slot % 7 AS bow FROM psi_off) GROUP BY ROLLUP (psi, bow) HAVING grouping(psi) = 0) GROUP BY bow, whole", *_PSI)  # fmt: skip
def psi_table_k(s, d):
    """The best psi for each day of the week and over all, after three steps."""
    return _psi_table(_psi_errors(s, d, **THREE))


def psi_table(s, d):
    """The same of converged chains, for both models."""
    two = [_kernel(s, UP), _kernel(s, DOWN)]
    sp, tp = _psi_table(_psi_errors(s, d)), _psi_table(_psi_errors(s, d, two, chain.Model("two")))
    return sp.withColumn("model", F.lit("sp")).unionByName(tp.withColumn("model", F.lit("tp")))


def psi_cross_validation(s, d):
    """Five folds by a hash of the link, which SQL has not."""
    return _psi_best(_psi_errors(s, d))


def _event_sql() -> str:
    zero = lambda t, v: f"SELECT slot, link_id, CASE WHEN {CLOSED} THEN 0 ELSE {v} END / sum(CASE WHEN {CLOSED} THEN 0 ELSE {v} END) OVER (PARTITION BY slot) AS p FROM {t}"
    box = f"SELECT slot, link_id, CASE WHEN {CLOSED} THEN 0 WHEN {BOX} THEN p + gone * p / mass ELSE p END AS p FROM (SELECT *, sum(CASE WHEN {CLOSED} THEN p ELSE 0 END) OVER (PARTITION BY slot) AS gone, sum(CASE WHEN {BOX} THEN p ELSE 0 END) OVER (PARTITION BY slot) AS mass FROM {{}})"
    shut = "src NOT IN (3, 50) AND dst NOT IN (3, 50)"
    parts = [f"truth AS (SELECT slot - 7 AS slot, link_id, p FROM prior), moved AS ({box.format('prior')}), t_zero AS ({zero('truth', 'p')}), t_box AS ({box.format('truth')})"]
    for name, powers in (("k", SP), ("u", UP), ("w", DOWN)):
        parts += [_kernel_sql(f"{name}_all", powers), _kernel_sql(f"{name}_open", powers, shut)]
    rows = []
    for model in ("sp", "tp"):
        for cond, prior, which in (("none", "prior", "all"), ("surgery2", "moved", "open")):
            name = f"{model}_{cond}"
            parts.append(_walk(name, prior, f"k_{which}", 3) if model == "sp" else _walk_two(name, prior, f"u_{which}", f"w_{which}", 3))
            parts.append(f"{name}_z AS ({zero(f'(SELECT * FROM {name} WHERE k = 3)', 'v' if model == 'sp' else '(u + d)')})")
        for cond, walk, target in (("none", "none", "t_zero"), ("surgery2", "surgery2", "t_zero"), ("surgery_box", "surgery2", "t_box")):
            rows.append(f"SELECT '{model}' AS model, '{cond}' AS surgery, round(avg(b), 6) AS box_mean, round(stddev_pop(b), 6) AS box_dev, round(avg(w), 6) AS whole_mean, round(stddev_pop(w), 6) AS whole_dev FROM (SELECT slot, avg(o) FILTER ({BOX}) AS b, avg(o) FILTER (NOT ({CLOSED})) AS w FROM (SELECT slot, link_id, abs(t.p - z.p) / (t.p + CAST(1e-6 AS DOUBLE)) AS o FROM {target} t JOIN {model}_{walk}_z z USING (slot, link_id)) GROUP BY slot)")
    X.SQL["event"] = ", ".join(parts)
    return " UNION ALL ".join(rows)


@_query(_event_sql(), *_PRIOR, "adjacency", "event")
def event_report_k(s, d):
    return _event_report(s, d, **THREE)


def event_report(s, d):
    """Converged chains, which SQL would take hundreds of steps for."""
    return _event_report(s, d)


def _event_report(s, d, **steps):
    _checkpointed(s)
    p = _prior(s, d)
    truth = p.select((F.col("slot") - 7).alias("slot"), "link_id", "p")
    r = sweeps.event_report(p, truth, X.adjacency(s), X.links(s), F.expr(CLOSED), F.expr(BOX), {"sp": [SP], "tp": [UP, DOWN]}, {"sp": chain.Model(), "tp": chain.Model("two")}, **steps)
    return r.select("model", "surgery", *(F.round(c, 6).alias(c) for c in ("box_mean", "box_dev", "whole_mean", "whole_dev")))


def fit_exponents(s, d):
    """Exponents of speed and lanes that bring the chain from origins nearest to the shares of a week later: a coarse search, three rounds of 20 steps."""
    _checkpointed(s)
    p = _prior(s, d).checkpoint()
    truth = p.select((F.col("slot") - 7).alias("slot"), "link_id", "p").checkpoint()
    x, f = sweeps.fit_exponents(sweeps.chain_loss(p, truth, X.adjacency(s), X.links(s), max_iter=20), [(0.0, 0.0)], step=1.0, least=0.5, max_rounds=3)
    return s.createDataFrame([(*x, f)], "speed double, lanes double, loss double")


# Links and reports


X.SQL["two_counts"] = "c1 AS (SELECT link_id, count(*) AS n FROM (SELECT route_id, arg_min(link_id, fix_idx) AS link_id FROM fixes GROUP BY ALL) GROUP BY ALL), c2 AS (SELECT link_id, count(DISTINCT route_id) AS n FROM fixes GROUP BY ALL)"


def _two_counts(s, d):
    f = X.fixes(s, d)
    return network.trips_per_link(f.groupBy("route_id").agg(F.min_by("link_id", "fix_idx").alias("link_id"))), network.trips_per_link(f)


@_query("SELECT len(list_filter(e, lambda x: x < length)) AS bucket, count(*) AS links, round(avg(CAST(coalesce(c2.n, 0) > 0 AS INT)) - avg(CAST(coalesce(c1.n, 0) > 0 AS INT)), 9) AS delta, round(avg(coalesce(c2.n, 0)) / nullif(avg(coalesce(c1.n, 0)), 0), 6) AS ratio FROM sized LEFT JOIN c1 USING (link_id) LEFT JOIN c2 USING (link_id), (SELECT quantile_cont(length, [0.2, 0.4, 0.6, 0.8, 0.99, 1.0]) AS e FROM sized) GROUP BY ALL", "links", "fixes", "sized", "two_counts")
def length_comparison(s, d):
    """Two runs' trips on links by length; one run counts a trip where it begins, the other wherever it goes."""
    sized = X.links(s).select("link_id", (F.col("speed") * F.col("lanes") + F.col("link_id") * 0.5).alias("length"))
    return network.compare_buckets(sized, *_two_counts(s, d)).select("bucket", "links", F.round("delta", 9).alias("delta"), F.round("ratio", 6).alias("ratio"))


@_query("SELECT count(*) AS links, count(c1.n) AS covered1, count(c2.n) AS covered2, count(*) FILTER (c1.n IS NULL AND c2.n IS NOT NULL) AS extra FROM links LEFT JOIN c1 USING (link_id) LEFT JOIN c2 USING (link_id)", "links", "fixes", "two_counts")
def coverage_gain(s, d):
    return network.coverage_gain(X.links(s), *_two_counts(s, d))


@_query("SELECT declared, CASE WHEN declared = (SELECT min(declared) FROM runs WHERE measured < declared) THEN 'chosen' WHEN measured - declared > 0.5 THEN 'too tight' WHEN measured > declared THEN 'slightly too tight' ELSE 'too loose' END AS verdict FROM runs", "runs")
def sigma_verdicts(s, d):
    """The runs as result files, one JSON object each, scanned over a glob."""
    at = _workspace(s)
    X.runs(s, d).select(F.col("declared").alias("declared_sigma"), F.struct(F.col("measured").alias("sigma_std")).alias("stats")).write.option("maxRecordsPerFile", 1).json(f"{at}/runs")
    runs = files.result_json(s, f"{at}/run*/*.json", "declared_sigma double, stats struct<sigma_std:double>")
    return stats.sigma_table(runs.select(F.col("declared_sigma").alias("declared"), F.col("stats.sigma_std").alias("measured"))).select("declared", "verdict")


# Matching, residuals of trips, networks


X.SQL["trip_pings"] = "trip_pings AS (SELECT did AS route_id, us // 1000000 AS sec, seq, lat, lon, link_id, row_number() OVER (PARTITION BY did ORDER BY us, seq) - 1 AS fix_idx FROM pings)"


def _trip_pings(s, d):
    from pyspark.sql.window import Window as W

    order = F.row_number().over(W.partitionBy("did").orderBy("us", "seq")) - 1
    return X.pings(s, d).select(F.col("did").alias("route_id"), F.floor(F.col("us") / 1_000_000).alias("sec"), "seq", "lat", "lon", "link_id", order.alias("fix_idx"))


_PROJ = lambda lat, lon: (f"radians({lon} + CAST(111.90 AS DOUBLE)) * CAST(6371000 AS DOUBLE) * cos(radians(CAST(40.75 AS DOUBLE)))", f"radians({lat} - CAST(40.75 AS DOUBLE)) * CAST(6371000 AS DOUBLE)")
X.SQL["trip_off"] = (
    "asked AS (SELECT route_id, fix_idx, link_id, sec + CASE WHEN fix_idx % 5 = 0 THEN 0.4 WHEN fix_idx % 5 = 1 THEN 0.6 ELSE 0 END AS t FROM trip_pings WHERE route_id IN (SELECT route_id FROM trip_pings GROUP BY ALL HAVING count(DISTINCT link_id) >= 3)), "
    "last_ping AS (SELECT route_id, sec, arg_max(lat, seq) AS lat, arg_max(lon, seq) AS lon FROM trip_pings GROUP BY ALL), "
    f"placed AS (SELECT a.route_id, a.fix_idx, a.link_id, {_PROJ('p.lat', 'p.lon')[0]} AS px, {_PROJ('p.lat', 'p.lon')[1]} AS py FROM asked a JOIN last_ping p ON p.route_id = a.route_id AND p.sec = CAST(round(a.t) AS BIGINT)), "
    f"shapes AS (SELECT link_id, {_PROJ('lat1', 'lon1')[0]} AS ax, {_PROJ('lat1', 'lon1')[1]} AS ay, {_PROJ('lat2', 'lon2')[0]} AS bx, {_PROJ('lat2', 'lon2')[1]} AS by_ FROM links UNION ALL SELECT link_id, {_PROJ('lat1', 'lon1')[0]}, {_PROJ('lat1', 'lon1')[1]}, {_PROJ('lat1', 'lon2')[0]}, {_PROJ('lat1', 'lon2')[1]} FROM links), "
    "trip_off AS (SELECT route_id, fix_idx, min(sqrt((px - ax - t * dx) ** 2 + (py - ay - t * dy) ** 2)) AS d FROM (SELECT *, greatest(0, least(1, ((px - ax) * dx + (py - ay) * dy) / greatest(dx * dx + dy * dy, CAST(1e-9 AS DOUBLE)))) AS t FROM (SELECT route_id, fix_idx, px, py, ax, ay, bx - ax AS dx, by_ - ay AS dy FROM placed JOIN shapes USING (link_id))) GROUP BY ALL)"
)


def _trip_off(s, d):
    """Fixes at the pings' seconds, some of them a little later, and a few more in the next second, where a ping is only by chance."""
    p = _trip_pings(s, d)
    fixes = p.select("route_id", "fix_idx", "link_id", (F.col("sec") + F.when(F.col("fix_idx") % 5 == 0, 0.4).when(F.col("fix_idx") % 5 == 1, 0.6).otherwise(0.0)).alias("t"))
    known = X.links(s).select("link_id", "lat1", "lon1", "lat2", "lon2")
    return network.trip_residuals(fixes, p, known.unionByName(known.withColumn("lat2", F.col("lat1"))))


@_query("SELECT route_id, fix_idx, round(d, 3) AS d FROM trip_off", "pings", "links", "trip_pings", "trip_off")
def trip_residuals(s, d):
    return _trip_off(s, d)[0].select("route_id", "fix_idx", F.round("d", 3).alias("d"))


@_query("SELECT count(*) FILTER (a.link_id NOT IN (SELECT link_id FROM links)) AS no_shape, count(*) FILTER (a.link_id IN (SELECT link_id FROM links) AND p.sec IS NULL) AS no_ping FROM asked a LEFT JOIN last_ping p ON p.route_id = a.route_id AND p.sec = CAST(round(a.t) AS BIGINT) WHERE a.route_id IN (SELECT route_id FROM last_ping)", "pings", "links", "trip_pings", "trip_off")
def trip_residual_skips(s, d):
    return _trip_off(s, d)[1]


def _road(s, d):
    """A road a trip: a node a fix, with an end at every fifth and at the last, and a side street at the third node of every seventh road.

    Links run between neighbouring ends, and back as well on two roads of three.
    """
    fix = X.fixes(s, d).select("route_id", F.col("fix_idx").alias("i"), (F.col("route_id") * 1000 + F.col("fix_idx")).alias("id"), F.max("fix_idx").over(W.partitionBy("route_id")).alias("last"))
    at = _workspace(s)
    fix.write.parquet(at)  # nodes, edges, ends and links all read it
    fix = s.read.parquet(at)
    two_way = lambda a, b: F.array(*(F.struct(x.alias("a"), y.alias("b")) for x, y in ((a, b), (b, a))))
    none = F.array().cast("array<struct<a:bigint,b:bigint>>")
    on = F.when(F.col("i") < F.col("last"), two_way(F.col("id"), F.col("id") + 1)).otherwise(none)
    side = F.when((F.col("i") == 2) & (F.col("route_id") % 7 == 0), two_way(F.col("id"), F.col("route_id") * 1000 + 900)).otherwise(none)
    edges = fix.select(F.inline(F.concat(on, side)))
    ends = fix.where("i % 5 = 0 OR i = last").select("id")
    far = F.col("route_id") * 1000 + F.least(F.col("i") + 5, F.col("last"))
    ahead = fix.where("i % 5 = 0 AND i < last").select((F.col("id") * 2).alias("link_id"), F.col("id").alias("u"), far.alias("v"), "route_id")
    back = ahead.where("route_id % 3 <> 0").select((F.col("link_id") + 1).alias("link_id"), F.col("v").alias("u"), F.col("u").alias("v"))
    return edges, ends, ahead.drop("route_id").unionByName(back)


X.SQL["on_roads"] = (
    "on_roads AS (SELECT route_id, fix_idx AS i, fix_idx // 5 * 5 AS e, max(fix_idx) OVER (PARTITION BY route_id) AS last FROM fixes), "
    "named AS (SELECT route_id, route_id * 1000 + i AS id, (route_id * 1000 + e) * 2 AS link_id FROM on_roads WHERE i < last AND NOT (route_id % 7 = 0 AND e = 0 AND least(e + 5, last) > 2))"
)


@_query("SELECT id AS a, id + 1 AS b, link_id FROM named UNION ALL SELECT id + 1, id, link_id + 1 FROM named WHERE route_id % 3 <> 0", "fixes", "on_roads")
def chain_walk(s, d):
    _checkpointed(s)
    return network.walk_chains(*_road(s, d)).select("a", "b", "link_id")


def _match_pings(s, d):
    return _numbered(s, d).withColumn("fix_idx", F.col("seq")).select("route_id", "fix_idx", (F.col("us") / 1e6).alias("t"), "lat", "lon")


def _match_graph(s):
    return X.links(s).select("link_id", "lat1", "lon1", "lat2", "lon2"), X.adjacency(s)


def _match(s, d):
    _checkpointed(s)
    pings = _match_pings(s, d)
    return pings, matching.match(pings, *_match_graph(s), min_fixes=2)


def hmm_match(s, d):
    return _match(s, d)[1].select("route_id", "fix_idx", "link_id")


def hmm_paths(s, d):
    """The matched links with those passed between two pings."""
    _checkpointed(s)
    pings = _match_pings(s, d)
    return matching.match_paths(pings, *_match_graph(s), min_fixes=2).select("route_id", "fix_idx", "i", "link_id", "emitting", "linked")


def match_counters(s, d):
    pings, matched = _match(s, d)
    return matching.match_counters(pings, matched, 2)


# Scans and sinks, as round trips


@_query("SELECT CAST(did AS VARCHAR) AS did, us // 1000000 AS sec, round(lat, 6) AS lat, round(lon, 6) AS lon FROM pings", "pings")
def csv_scan(s, d):
    at = _workspace(s)
    p = X.pings(s, d)
    p.select("did", F.date_format(F.timestamp_seconds(F.floor(F.col("us") / 1_000_000)), "yyyy-MM-dd HH:mm:ss"), "lat", "lon", F.lit("x"), F.lit(1)).write.csv(at)
    c = files.csv_pings(s, at)
    return c.select("did", F.floor(F.col("us") / 1_000_000).alias("sec"), F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


@_query("SELECT route_id, CAST(fix_idx AS INT) AS fix_idx, CAST(link_id AS VARCHAR) AS link_id, CAST(fix_idx AS DOUBLE) AS t FROM fixes", "fixes")
def route_lines(s, d):
    """Trips written one a line, and read back."""
    at = _workspace(s)
    sinks.write_routes(X.fixes(s, d).withColumn("t", F.col("fix_idx").cast("double")), at)
    return files.matched_lines(s, at)[0]


@_query("SELECT route_id, count(*) AS pings, min(fix_idx) AS first_sec, max(fix_idx) AS last_sec FROM fixes GROUP BY ALL", "fixes")
def ping_parquet(s, d):
    """Pings appended in two batches, and trips put together again whichever batch they are in."""
    at = _workspace(s)
    p = X.fixes(s, d).select("route_id", F.col("fix_idx").alias("time_sec"), F.lit(40.7).alias("lat"), F.lit(-111.9).alias("lon"))
    sinks.append_pings(p.where("time_sec % 2 = 0"), at)
    sinks.append_pings(p.where("time_sec % 2 = 1"), at)
    t = files.parquet_trips(s, at)
    return t.select("route_id", F.size("pings").cast("long").alias("pings"), F.col("pings")[0]["time_sec"].cast("int").alias("first_sec"), F.element_at("pings", -1)["time_sec"].cast("int").alias("last_sec"))


@_query("SELECT slot, link_id, c FROM counts", "pings", "counts")
def matrix_by_date(s, d):
    at = _workspace(s)
    sinks.write_matrix(_counts(s, d).select((F.col("slot") * 86400).alias("slot"), "link_id", "c"), at)
    return s.read.parquet(at).select(F.floor(F.col("slot") / 86400).alias("slot"), "link_id", "c")


@_query("SELECT src, dst, count(*) AS n FROM adjacency WHERE src IN (SELECT link_id FROM links) GROUP BY ALL", "streets", "passes")
def graph_scan(s, d):
    """The graph as JSON objects, one a file for every 500 link ids, written and scanned."""
    at = _workspace(s)
    block = lambda c: F.floor(F.col(c) / 500).alias("block")
    links = X.streets(s, d).groupBy(block("link_id")).agg(F.map_from_entries(F.collect_list(F.struct(F.col("link_id").cast("string"), F.struct("speed", "lanes")))).alias("links"))
    edges = X.passes(s, d).groupBy("src").agg(F.collect_list(F.col("dst").cast("string")).alias("d"))
    edges = edges.groupBy(block("src")).agg(F.map_from_entries(F.collect_list(F.struct(F.col("src").cast("string"), "d"))).alias("adjacency"))
    links.join(edges, "block", "full").drop("block").write.option("maxRecordsPerFile", 1).json(at)
    links, adjacency = files.graph_json(s, at)
    known = links.select("link_id")
    return adjacency.join(known.withColumnRenamed("link_id", "src"), "src", "left_semi").select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).groupBy("src", "dst").agg(F.count("*").alias("n"))


@_query("SELECT strftime(unnest(generate_series(date_trunc('minute', min(ts)), date_trunc('minute', max(ts)), INTERVAL 5 MINUTE)), '%Y-%m-%d %H:%M:%S') AS label FROM events")
def slot_labels(s, d):
    """Labels of all slots from the first event's minute to the last one's."""
    first, last = s.read.parquet(f"{d}/events.parquet").agg(*(F.date_format(f("ts"), "yyyy-MM-dd HH:mm:00") for f in (F.min, F.max))).first()
    return calendar.slots(s, first, last).select("label")


@_query("SELECT (4 + ((us // 300000000 - 5960000) % 2016 + 2016) % 2016 // 288) % 7 AS dow, count(*) AS n FROM pings GROUP BY ALL", "pings")
def calendar_days(s, d):
    bow = calendar.bin_of_week(calendar.slot_of(F.col("us")), F.lit(5960000))
    return X.pings(s, d).groupBy(calendar.day_of_week(bow).alias("dow")).agg(F.count("*").alias("n"))


#: Without SQL: converged chains by the hundred, a hash that it lacks, a search, and decoding; unit tests hold these.
_Q |= {f.__name__: f for f in (psi_chain_errors, psi_grid_fit, psi_table, psi_cross_validation, event_report, fit_exponents, hmm_match, hmm_paths, match_counters)}
