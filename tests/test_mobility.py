"""Chains, matching, sweeps, scans, sinks and streams on tables that can be worked out by hand."""

import heapq
import json
import math
import struct
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wayflow.operators import chain, graph, matching, network, stats, sweeps, trips
from wayflow.plans import catalog
from wayflow.plans import studies as S
from wayflow.plans.catalog import X
from wayflow.sources import files, sinks
from wayflow.streaming import live

EDGES = [(0, 1), (1, 2), (2, 0), (0, 2), (3, 0), (1, 4), (1, 4)]  # link 4 has no successor, one edge comes twice


@pytest.fixture(autouse=True)
def checkpoints(spark, tmp_path_factory):
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))


def kernel(spark, seed):
    r = np.random.default_rng(seed)
    w = spark.createDataFrame([(k, float(x)) for k, x in enumerate(r.uniform(0.5, 2, 5))], "link_id long, w double")
    return graph.kernel(spark.createDataFrame(EDGES, "src long, dst long"), w)


def dense(k):
    out = np.zeros((5, 5))
    for r in k.collect():
        out[r.dst, r.src] += r.p
    return out


def prior(spark):
    rows = [(s, k, float(p)) for s, ps in enumerate(np.random.default_rng(1).dirichlet(np.ones(5), 4)) for k, p in enumerate(ps)]
    return spark.createDataFrame(rows, "slot long, link_id long, p double")


@pytest.mark.parametrize("model", [chain.Model(), chain.Model(to_prior=True), chain.Model("two"), chain.Model("two", to_prior=True), chain.Model("damped")])
def test_chain_forms_agree_with_a_dense_solution(spark, model):
    ks = [kernel(spark, 1), kernel(spark, 2)] if model.kind == "two" else [kernel(spark, 1)]
    mats, p = [dense(k) for k in ks], prior(spark)
    for form, tol in ((chain.vector, 1e-7), (chain.relational, 0.15)):  # a step of the relational form is some jobs
        want = solved(p, mats, model, tol)
        assert model != chain.Model() or form is chain.relational or len({s for _, s in want.values()}) > 1  # slots stop one by one
        got = {(r.slot, r.link_id): (r.v, r.steps) for r in form(p, ks, model, tol, 200).collect()}
        assert got.keys() == want.keys()
        assert all(abs(got[k][0] - want[k][0]) < 1e-9 and got[k][1] == want[k][1] for k in want)


def solved(p, mats, model, tol):
    """Every slot by itself with dense matrices: v and the steps taken."""
    want = {}
    for slot in range(4):
        e = np.array([r.p for r in sorted(p.where(F.col("slot") == slot).collect(), key=lambda r: r.link_id)])
        u, d, steps = e, np.zeros(5), 200
        push = lambda m, x: m @ x + (x[4] * e if model.to_prior else 0)  # noqa: E731, B023
        for k in range(1, 201):
            if model.kind == "two":
                a, b = (1 - model.beta) * push(mats[0], u) + model.rho * e * d.sum(), model.beta * u + (1 - model.rho) * push(mats[1], d)
            elif model.kind == "damped":
                a, b = model.damping * push(mats[0], u) + (1 - model.damping) * e, d
            else:
                a, b = model.alpha * e + (1 - model.alpha) * push(mats[0], u), d
            if model.kind != "damped":
                a, b = a / (a.sum() + b.sum()), b / (a.sum() + b.sum())
            change = np.abs(a - u).sum() + np.abs(b - d).sum()
            u, d = a, b
            if change < tol:
                steps = k
                break
        want |= {(slot, k): (v, steps) for k, v in enumerate(u + d)}
    return want


def test_stationary_goes_on_when_the_kernel_is_large(spark):
    p, k = prior(spark), kernel(spark, 1)
    a, b = ({(r.slot, r.link_id): r.v for r in chain.stationary(p, [k], tol=0.05, max_edges=m).collect()} for m in (100, 1))
    assert a.keys() == b.keys() and all(abs(a[x] - b[x]) < 1e-12 for x in a)
    assert chain.stationary(p.limit(0), [k]).count() == 0


def test_smoothing_without_a_dense_table(spark):
    links = spark.range(5).select(F.col("id").alias("link_id"))
    counts = spark.createDataFrame([(0, 0, 3.0), (0, 2, 1.0), (1, 4, 2.0)], "slot long, link_id long, c double")
    uniform = graph.kernel(spark.createDataFrame(EDGES, "src long, dst long"))
    want = {(r.slot, r.link_id): r.p for r in graph.diffuse(graph.laplace(counts, links), uniform).collect()}
    rows = graph.smoothed(counts, links, uniform).collect()
    got = {(r.slot, r.link_id): r.p for r in rows}
    rest = {r.slot: (r.p_link, r.p_dead) for r in rows}
    assert all(abs(got.get((s, k), rest[s][k == 4]) - p) < 1e-12 for (s, k), p in want.items())


def roads(spark):
    """Two parallel streets 110 m apart, each of ten links that run east, and a cross street between them."""
    rows = [(k + 10 * row, 40.75 + 0.001 * row, -111.9 + 0.002 * k, 40.75 + 0.001 * row, -111.9 + 0.002 * (k + 1)) for row in range(2) for k in range(10)]
    rows.append((20, 40.75, -111.89, 40.751, -111.89))
    segments = spark.createDataFrame(rows, "link_id long, lat1 double, lon1 double, lat2 double, lon2 double")
    steps = [(k + 10 * row, k + 1 + 10 * row) for row in range(2) for k in range(9)] + [(4, 20), (20, 15)]
    return segments, spark.createDataFrame(steps, "src long, dst long")


def test_quantiles_with_infinities(spark):
    r = np.random.default_rng(3)
    values = [*map(float, r.normal(0, 5, 4000)), *[math.inf] * 900, *[-math.inf] * 700, 1e308, -1e308, 5e-324, 0.0, 0.0]
    rows = spark.createDataFrame([(v,) for v in [*values, None, math.nan]], "x double")
    at = [0.0, 0.05, 0.125, 0.25, 0.5, 0.75, 0.999, 1.0]
    with np.errstate(invalid="ignore"):
        want = [float(np.quantile(values, q, method="lower")) for q in at], [float(np.quantile(values, q, method="higher")) for q in at]
    for got, a, z in zip(stats.quantiles(rows, "x", at, bins=16, small=20), *want, strict=True):
        assert a <= got <= z
    assert stats.quantiles(rows.where("x = double('inf')"), "x", [0.5]) == [math.inf]
    assert stats.quantiles(spark.createDataFrame([(1e308,), (-1e308,), (5e307,)], "x double"), "x", [0.5], small=1) == [5e307]
    assert math.isnan(stats.quantiles(rows.limit(0), "x", [0.5])[0])


def test_grouped_quantiles_equal_numpy(spark):
    """One group has nine rows of ten, another nothing but nulls, a third the null key, a fourth infinities."""
    r = np.random.default_rng(4)
    data = [("hot", float(v), float(round(v))) for v in r.normal(0, 5, 5000)] + [("few", float(k), None) for k in range(4)] + [(None, 2.5, 1.0), (None, 3.5, math.nan)]
    data += [("none", None, None), ("edge", math.inf, -math.inf), ("edge", 1.0, math.inf), ("edge", math.inf, 0.0)]
    rows = spark.createDataFrame(data, "k string, x double, y double")
    at = [0.0, 0.1, 0.5, 0.9, 1.0]
    got = {x.k: x for x in stats.grouped_quantiles(rows, ["k"], ["x", "y"], at).collect()}
    assert got.keys() == {"hot", "few", None, "none", "edge"} and got["none"].x is None and got["few"].y is None
    for k, column in (("hot", 1), ("hot", 2), ("few", 1), (None, 1)):
        want = np.quantile([v[column] for v in data if v[0] == k], at)
        assert np.allclose(got[k][column], want, rtol=1e-12, atol=1e-12)
    assert got[None].y == [1.0] * 5 and got["edge"].x[2:] == [math.inf] * 3 and got["edge"].y[2] == 0.0 and got["edge"].y[4] == math.inf
    assert stats.grouped_quantiles(rows.limit(0), ["k"], ["x"], [0.5]).count() == 0


def test_the_last_of_repeated_cells_stands(spark):
    cells = spark.createDataFrame([(1, 1, 5.0, 1), (1, 1, 2.0, 2), (1, 9, 3.0, 3)], "slot long, link_id long, c double, at long")
    links = spark.createDataFrame([(1,), (2,)], "link_id long")
    assert [tuple(x) for x in graph.project(cells, links, "at").collect()] == [(1, 1, 2.0)] and graph.project(cells, links).first().c == 7.0


def test_psi_table_by_hour_and_over_all(spark):
    """Rows without an hour are a group of their own beside the row over all."""
    r = np.random.default_rng(9)
    rows = [(psi, slot, link, float(x), float(x * x)) for psi in (-0.01, 0.0, 0.01) for slot in range(6) for link in range(3) for x in [abs(r.normal(0, 1))]]
    errors = spark.createDataFrame(rows, "psi double, slot long, link_id long, abs double, sq double")
    hour = lambda s: None if s == 5 else s % 2
    got = {(x.whole, x.hour): (x.psi, x.mae, x.mse, x.base_mae, x.base_mse) for x in sweeps.psi_table(errors, F.when(F.col("slot") != 5, F.col("slot") % 2)).collect()}
    assert got.keys() == {(True, None), (False, None), (False, 0), (False, 1)}
    for (whole, h), found in got.items():
        of = {psi: [x for x in rows if x[0] == psi and (whole or hour(x[1]) == h)] for psi in (-0.01, 0.0, 0.01)}
        mean = {psi: (float(np.mean([x[3] for x in some])), float(np.mean([x[4] for x in some]))) for psi, some in of.items()}
        best = min(mean, key=lambda psi: (mean[psi][1], psi))
        assert np.allclose(found, (best, *mean[best], *mean[0.0]))


def test_matching_follows_the_street(spark):
    segments, adjacency = roads(spark)
    r = np.random.default_rng(5)
    straight = [(1, k, float(k), 40.75 + r.normal(0, 8e-5), -111.9 + 0.002 * k + 0.001) for k in range(10)]
    straight[6] = (1, 6, 6.0, 40.7506, straight[6][4])  # nearer to the other street, which has no way back
    turn = [(2, k, float(k), 40.75, -111.9 + 0.002 * k + 0.001) for k in range(5)] + [(2, 5, 5.0, 40.7505, -111.89)] + [(2, k + 1, k + 1.0, 40.751, -111.9 + 0.002 * k + 0.001) for k in range(5, 9)]
    far = [(3, k, float(k), 41.9, -111.9) for k in range(6)]
    short = [(4, 0, 0.0, 40.75, -111.9)]
    pings = spark.createDataFrame(straight + turn + far + short, "route_id long, fix_idx long, t double, lat double, lon double")
    got = {}
    for x in matching.match(pings, segments, adjacency).orderBy("route_id", "fix_idx").collect():
        got.setdefault(x.route_id, []).append(x.link_id)
    assert got == {1: list(range(10)), 2: [0, 1, 2, 3, 4, 20, 15, 16, 17, 18]}
    counters = matching.match_counters(pings, matching.match(pings, segments, adjacency)).first().asDict()
    assert counters == {"trips": 4, "too_short": 1, "matched": 2, "unmatched": 1}


def test_matching_equals_dijkstra_and_viterbi(spark):
    """Sparse pings on a street grid of 150 m, some two kilometres apart, against a plain decoder over plain shortest ways."""
    r = np.random.default_rng(11)
    side, step = 9, 150.0
    at = lambda x, y: (40.75 + float(np.degrees(y / 6371000)), -111.90 + float(np.degrees(x / (6371000 * np.cos(np.radians(40.75))))))
    shape = {}
    for x in range(side):
        for y in range(side):
            for dx, dy in ((1, 0), (-1, 0), (0, 1), (0, -1)):
                if 0 <= x + dx < side and 0 <= y + dy < side and r.uniform() < 0.85:
                    shape[len(shape)] = ((x, y), (x + dx, y + dy))
    shape = {k: tuple((float(p[0]) * step + jog[0], float(p[1]) * step + jog[1]) for p in ends) for k, ends in shape.items() for jog in [(float(r.normal(0, 3)), float(r.normal(0, 3)))]}
    cell = lambda p: (round(p[0] / step), round(p[1] / step))
    after = {k: [j for j, (u, v) in shape.items() if cell(u) == cell(b) and cell(v) != cell(a)] for k, (a, b) in shape.items()}
    size = {k: float(np.hypot(b[0] - a[0], b[1] - a[1])) for k, (a, b) in shape.items()}
    track = {1: [(20, 10), (600, 130), (1190, 1180), (300, 900), (40, 60)], 2: [(0, 1200), (1200, 0), (1150, 420)], 3: [(150, 20), (150, 200), (160, 420), (330, 450)]}
    points = [(t, k, float(k), float(x + r.normal(0, 8)), float(y + r.normal(0, 8))) for t, way in track.items() for k, (x, y) in enumerate(way)]
    max_dist, sigma, beta, detour = 120.0, 20.0, 50.0, 1500.0

    def ways(a):
        """Least metres between the end of a and the start of every link."""
        todo, gap = [(0.0, j) for j in after[a]], {}
        while todo:
            g, j = heapq.heappop(todo)
            if j not in gap:
                gap[j] = g
                for n in after[j]:
                    heapq.heappush(todo, (g + size[j], n))
        return gap

    def near(x, y):
        for k, ((ax, ay), (bx, by)) in shape.items():
            u = max(0.0, min(1.0, ((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / size[k] ** 2))
            d = float(np.hypot(x - ax - u * (bx - ax), y - ay - u * (by - ay)))
            if d <= max_dist:
                yield k, d, u * size[k]

    gaps, want = {k: ways(k) for k in shape}, {}
    for t in track:
        chain, before = [], None
        for _, k, _, x, y in [p for p in points if p[0] == t]:
            now = {}
            for j, d, along in near(x, y):
                own, steps = 0.5 * (d / sigma) ** 2, []
                for i, (cost, start, _) in (before[0] if before else {}).items():
                    straight = float(np.hypot(x - before[1], y - before[2]))
                    way = along - start if i == j and along >= start else size[i] - start + gaps[i].get(j, np.inf) + along
                    if way <= straight + detour:
                        steps.append((cost + abs(way - straight) / beta, i))
                if steps or before is None:
                    cost, back = min(steps) if steps else (0.0, None)
                    now[j] = (own + cost, along, back)
            assert now
            before = (now, x, y)
            chain.append((k, now))
        link = min(chain[-1][1], key=lambda j: chain[-1][1][j][0])
        for k, now in reversed(chain):
            want[t, k] = link
            link = now[link][2]
    pings = spark.createDataFrame([(t, k, s, *at(x, y)) for t, k, s, x, y in points], "route_id long, fix_idx long, t double, lat double, lon double")
    segments = spark.createDataFrame([(k, *at(*a), *at(*b)) for k, (a, b) in shape.items()], "link_id long, lat1 double, lon1 double, lat2 double, lon2 double")
    adjacency = spark.createDataFrame([(a, b) for a, bs in after.items() for b in bs], "src long, dst long")
    asked = {"max_dist": max_dist, "sigma": sigma, "beta": beta, "detour": detour, "min_fixes": 2}
    assert {(x.route_id, x.fix_idx): x.link_id for x in matching.match(pings, segments, adjacency, **asked).collect()} == want
    paths = {}
    for x in matching.match_paths(pings, segments, adjacency, **asked).orderBy("route_id", "fix_idx", "i").collect():
        paths.setdefault((x.route_id, x.fix_idx), []).append(x)
    for (t, k), rows in paths.items():
        assert rows[-1].emitting and rows[-1].link_id == want[t, k] and not any(x.emitting for x in rows[:-1]) and rows[0].linked == (k > 0)
        if k:
            links = [want[t, k - 1], *(x.link_id for x in rows)]
            assert len(rows) == 1 and links[0] == links[1] or all(b in after[a] for a, b in zip(links, links[1:], strict=False))
            assert abs(sum(size[j] for j in links[1:-1]) - (0 if len(rows) == 1 and links[0] == links[1] else gaps[links[0]][links[-1]])) < 1e-2
    assert max(map(len, paths.values())) > 6
    broken = matching.match(pings, segments, adjacency, **asked | {"max_leap": 500.0})
    assert broken.count() == len(points)
    assert matching.match(pings.limit(0), segments, adjacency).count() == 0 and matching.match(pings, segments.limit(0), adjacency).count() == 0


def test_a_segment_has_few_cells(spark):
    rows = [(1, 40.75, -111.9, 40.75, -111.9), (2, 40.0, -112.9, 41.5, -110.9), (3, 40.75, -111.9, 40.7511, -111.899), (4, None, -111.9, 40.7, -111.8)]
    segments = spark.createDataFrame(rows, "link_id long, lat1 double, lon1 double, lat2 double, lon2 double")
    many = {x["link_id"]: x["count"] for x in matching.cells(segments, 400.0).groupBy("link_id").count().collect()}
    assert many.keys() == {1, 2, 3} and max(many.values()) <= 16
    pings = spark.createDataFrame([(1, 0, 0.0, 40.75, -111.9), (1, 1, 1.0, 40.7505, -111.8995), (1, 2, 2.0, 41.4, -111.0), (1, 3, 3.0, None, None)], "route_id long, fix_idx long, t double, lat double, lon double")
    for reach in (50.0, 400.0, 5000.0):
        got = {(x.fix_idx, x.link_id) for x in matching.candidates(pings, segments, reach).collect()}
        every = network.measure_residuals(pings.crossJoin(segments.select("link_id")), segments, ["fix_idx", "link_id"]).where(F.col("d") <= reach).collect()
        assert got == {(x.fix_idx, x.link_id) for x in every}


def test_candidates_equal_all_pairs_within_reach(spark):
    segments, _ = roads(spark)
    r = np.random.default_rng(6)
    pings = spark.createDataFrame([(1, k, float(k), 40.74 + float(r.uniform(0, 0.02)), -111.91 + float(r.uniform(0, 0.04))) for k in range(60)], "route_id long, fix_idx long, t double, lat double, lon double")
    got = {(x.fix_idx, x.link_id): x.d for x in matching.candidates(pings, segments, 300.0).collect()}
    every = network.measure_residuals(pings.crossJoin(segments.select("link_id")), segments, ["fix_idx", "link_id"]).where("d <= 300").collect()
    assert got.keys() == {(x.fix_idx, x.link_id) for x in every} and all(abs(got[(x.fix_idx, x.link_id)] - x.d) < 1e-6 for x in every)


def test_chains_are_walked_between_ends(spark):
    e = [(1, 10), (10, 11), (11, 2), (2, 11), (11, 10), (10, 1), (2, 20), (20, 21), (20, 22), (3, 30), (30, 3)]
    edges = spark.createDataFrame(e, "a long, b long")
    ends = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    links = spark.createDataFrame([("fwd", 1, 2), ("back", 2, 1)], "link_id string, u long, v long")
    got = {(r.a, r.b): r.link_id for r in network.walk_chains(edges, ends, links).collect()}
    assert got == {(1, 10): "fwd", (10, 11): "fwd", (11, 2): "fwd", (2, 11): "back", (11, 10): "back", (10, 1): "back"}


def test_a_trip_spans_devices_no_more(spark):
    p = spark.createDataFrame([(d, k, k * 400_000_000 * (1 if k % 2 else 2)) for d in "abc" for k in range(4)], "did string, seq long, us long")
    got = trips.trip_ids(trips.sessionize(p, 300))
    assert sorted({r.route_id for r in got.collect()}) == list(range(1, got.select("did", "trip").distinct().count() + 1))


def test_pings_that_go_back_in_time_stay(spark):
    p = spark.createDataFrame([("a", 0, 0, 0.0, 0.0), ("a", 1, -5_000_000, 0.0, 0.0), ("a", 2, -5_000_000, 0.0, 0.0), ("a", 3, -5_000_000, 0.0, 0.001), ("a", 4, 0, 0.0, float("nan"))], "did string, seq long, us long, lat double, lon double")
    assert sorted(r.seq for r in trips.speed_filter(p).collect()) == [0, 1, 3]


@pytest.mark.parametrize("small", [1, 10, 100_000])
def test_quantiles_are_exact(spark, small):
    r = np.random.default_rng(2)
    x = np.concatenate([r.exponential(3, 700), np.full(200, 2.5), [1e6]])
    d = spark.createDataFrame([(float(v),) for v in x] + [(None,), (float("nan"),)], "x double")
    at = [0.0, 0.1, 0.5, 0.75, 0.999, 1.0]
    assert np.allclose(stats.quantiles(d, "x", at, bins=16, small=small), np.quantile(x, at))
    assert math.isnan(stats.quantiles(d.limit(0), "x", [0.5])[0])


def test_chi_square_tail(spark):
    # x with a tail of 0.05 for 1, 2, 5 and 10 degrees of freedom
    rows = [(3.841459, 1), (5.991465, 2), (11.070498, 5), (18.307038, 10)]
    got = spark.createDataFrame(rows, "x double, dof int").select(stats.chi2_tail("x", "dof").alias("p")).collect()
    assert all(abs(r.p - 0.05) < 1e-6 for r in got)


def test_chi_square_pools_upwards(spark):
    lengths = [0] * 60 + [1] * 20 + [2] * 12 + [3] * 4 + [7] * 2 + [9]
    n, p = len(lengths), 1 / (1 + np.mean(lengths))
    obs, exp, o, e = [], [], 0.0, 0.0
    for k in range(10):
        o, e = o + lengths.count(k), e + n * p * (1 - p) ** k
        if e >= 5:
            obs, exp, o, e = [*obs, o], [*exp, e], 0.0, 0.0
    obs, exp = np.array([*obs, o]), np.array([*exp, e + n * (1 - p) ** 10])
    exp *= obs.sum() / exp.sum()
    got = stats.chi2_geometric(spark.createDataFrame([(k,) for k in lengths], "k int"), "k").first()
    assert abs(got.chi2 - ((obs - exp) ** 2 / exp).sum()) < 1e-9 and (got.bins, got.dof) == (len(obs), max(len(obs) - 2, 1))


def test_exponents_are_found(spark):
    loss = lambda points: [(x - 1.7) ** 2 + (y + 0.5) ** 2 for x, y in points]
    x, f = sweeps.fit_exponents(loss, [(0.0, 0.0), (5.0, 5.0)], least=1e-4, max_rounds=100)
    assert np.allclose(x, (1.7, -0.5), atol=1e-3) and f < 1e-5
    x, _ = sweeps.fit_exponents(loss, [(0.0, 0.0)], least=1e-4, max_rounds=100, lower=(None, 0.0))
    assert np.allclose(x, (1.7, 0.0), atol=1e-3)


def test_folds_hold_every_link_out_once(spark):
    rows = [(float(psi), 0, k, abs(psi - (0.01 if k % 2 else 0.02)) * 100) for psi in (0.0, 0.01, 0.02) for k in range(40)]
    fit = sweeps.psi_fit(spark.createDataFrame(rows, "psi double, slot long, link_id long, sq double")).collect()
    assert sorted(r.part for r in fit) == list(range(5)) and all(r.psi in (0.01, 0.02) and r.base > 0 for r in fit)


def _tables(spark, s):
    """Prior, the shares of a week later, adjacency and links of the tables, as arrays over links 0 to 99."""
    prior = S._prior(spark, s).toPandas()
    p = prior.pivot(index="slot", columns="link_id", values="p")
    assert list(p.columns) == list(range(100))
    slots = [k for k in p.index if k + 7 in p.index]
    links = X.links(spark).toPandas().sort_values("link_id")
    return p, slots, X.adjacency(spark).toPandas(), links


def _plain_kernel(edges, links, powers):
    w = (links.speed / links.speed.mean()).to_numpy() ** powers[0] * (links.lanes / links.lanes.mean()).to_numpy() ** powers[1]
    k = np.zeros((100, 100))
    for a, b in zip(edges.src, edges.dst, strict=True):
        k[b, a] += w[b]
    return k / np.maximum(k.sum(0), 1e-300)


def _plain_chain(e, *kernels):
    """One slot's chain until its change is below 1e-5, 200 steps at most."""
    m, u, d = S.chain.Model(), e, np.zeros(100)
    for _ in range(200):
        if len(kernels) == 1:
            new, low = m.alpha * e + (1 - m.alpha) * kernels[0] @ u, d
        else:
            new = (1 - m.beta) * kernels[0] @ u + m.rho * e * d.sum()
            low = m.beta * u + (1 - m.rho) * kernels[1] @ d
        new, low = new / (new.sum() + low.sum()), low / (new.sum() + low.sum())
        off = abs(new - u).sum() + abs(low - d).sum()
        u, d = new, low
        if off < 1e-5:
            break
    return u + d


SHUT = np.isin(np.arange(100), (3, 50))
AREA = (np.arange(100) >= 20) & (np.arange(100) < 60) & (np.arange(100) != 50)


def test_psi_of_converged_chains(spark):
    sf = "/root/testdata/sf0.001"
    p, slots, edges, links = _tables(spark, sf)
    kernel, sq = _plain_kernel(edges, links, S.SP), {}
    for psi in S.PSI:
        off = []
        for k in slots:
            e = p.loc[k].to_numpy()
            b = e[AREA].sum()
            v = _plain_chain(np.where(SHUT, e, np.where(AREA, e * (1 + psi / b), e * (1 - psi / (1 - b)))), kernel)
            off.append((p.loc[k + 7].to_numpy() - v)[AREA] ** 2 * 1e12)
        sq[psi] = np.array(off)
    got = {round(r.psi, 6): r.mse for r in S.psi_chain_errors(spark, sf).collect()}
    assert got.keys() == sq.keys() and all(abs(got[x] - sq[x].mean()) <= 0.01 + 1e-6 * got[x] for x in got)
    folds = {r.link_id: r.f for r in X.links(spark).select("link_id", sweeps.fold().alias("f")).collect()}
    fold = np.array([folds[k] for k in np.flatnonzero(AREA)])
    single = np.where(np.flatnonzero(AREA) % 4 == 0, 0, 1)
    for rows, held in ((S.psi_cross_validation(spark, sf).collect(), fold), (S.psi_grid_fit(spark, sf).collect(), single)):
        assert sorted(r.part for r in rows) == (list(range(5)) if held is fold else [0])
        for r in rows:
            out = held == r.part
            best = min(S.PSI, key=lambda x: (round(sq[x][:, ~out].mean(), 4), x))
            assert round(r.psi, 6) == best
            for name, value in (("train", sq[best][:, ~out]), ("test", sq[best][:, out]), ("base", sq[0.0][:, out])):
                assert abs(r[name] - value.mean()) <= 0.01 + 1e-6 * value.mean()


def test_psi_table_of_both_models(spark):
    sf = "/root/testdata/sf0.001"
    p, slots, edges, links = _tables(spark, sf)
    got = {(r.model, r.whole, r.bow): r for r in S.psi_table(spark, sf).collect()}
    for model, powers in (("sp", [S.SP]), ("tp", [S.UP, S.DOWN])):
        kernels, off = [_plain_kernel(edges, links, x) for x in powers], {}
        for psi in S.PSI:
            for k in slots:
                e = p.loc[k].to_numpy()
                b = e[AREA].sum()
                v = _plain_chain(np.where(SHUT, e, np.where(AREA, e * (1 + psi / b), e * (1 - psi / (1 - b)))), *kernels)
                off[psi, k] = np.abs(p.loc[k + 7].to_numpy() - v)[AREA] * 1e6
        days = {None} | {k % 7 for k in slots}
        assert {k[1:] for k in got if k[0] == model} == {(x is None, x) for x in days}
        for day in days:
            mean = {psi: np.concatenate([off[psi, k] for k in slots if day is None or k % 7 == day]) for psi in S.PSI}
            best, r = min(S.PSI, key=lambda x: ((mean[x] ** 2).mean(), x)), got[model, day is None, day]
            assert round(r.psi, 6) == best
            for found, want in ((r.mae, mean[best].mean()), (r.mse, (mean[best] ** 2).mean()), (r.base_mae, mean[0.0].mean()), (r.base_mse, (mean[0.0] ** 2).mean())):
                assert abs(found - want) <= 0.01 + 1e-6 * want


def test_event_report_of_converged_chains(spark):
    sf = "/root/testdata/sf0.001"
    p, slots, edges, links = _tables(spark, sf)
    left = edges[~edges.src.isin((3, 50)) & ~edges.dst.isin((3, 50))]

    def zero(v):
        v = np.where(SHUT, 0, v)
        return v / v.sum()

    def moved(v):
        return np.where(SHUT, 0, np.where(AREA, v + v[SHUT].sum() * v / v[AREA].sum(), v))

    got = {(r.model, r.surgery): r for r in S.event_report(spark, sf).collect()}
    assert len(got) == 6
    for (model, surgery), row in got.items():
        ways = [_plain_kernel(edges if surgery == "none" else left, links, x) for x in ([S.SP] if model == "sp" else [S.UP, S.DOWN])]
        box, whole = [], []
        for k in slots:
            e, t = p.loc[k].to_numpy(), p.loc[k + 7].to_numpy()
            v = zero(_plain_chain(e if surgery == "none" else moved(e), *ways))
            t = moved(t) if surgery == "surgery_box" else zero(t)
            off = abs(t - v) / (t + 1e-6)
            box.append(off[AREA].mean())
            whole.append(off[~SHUT].mean())
        for name, value in (("box_mean", np.mean(box)), ("box_dev", np.std(box)), ("whole_mean", np.mean(whole)), ("whole_dev", np.std(whole))):
            assert abs(row[name] - value) <= 2e-6 * (1 + value), (model, surgery, name)


# Scans


def test_csv_keeps_the_order_of_arrival(spark, tmp_path):
    (tmp_path / "p.csv").write_text("b,2018-09-01 00:00:10,40.7,-111.9,x,9\na,not a time,40.7,-111.9,x,9\na,2018-09-01 00:00:05,,-111.9,x,9\nb,2018-09-01 00:00:02,40.8,-111.9,x,9\n")
    rows = files.csv_pings(spark, str(tmp_path / "p.csv")).orderBy("seq").collect()
    assert [(r.did, r.time_sec is None, r.lat) for r in rows] == [("b", False, 40.7), ("a", True, 40.7), ("a", False, None), ("b", False, 40.8)]
    assert rows[0].time_sec == 243 * 86400 + 10
    assert trips.valid(files.csv_pings(spark, str(tmp_path / "p.csv"))).count() == 2


def test_json_arrays_and_older_routes(spark, tmp_path):
    rows = [{"route": {"route_id": 1, "fixes": [["l1", 5.5], ["l2", 6]]}}, {"route": {"route_id": 2, "fixes": [], "routelinks": [["l9", 1, 2]]}}]
    (tmp_path / "a.json").write_text(json.dumps(rows, indent=1))
    got = [tuple(r) for r in files.matched_fixes(files.json_array(spark, str(tmp_path / "a.json"))).orderBy("route_id", "fix_idx").collect()]
    assert got == [(1, 0, "l1", 5.5), (1, 1, "l2", 6.0), (2, 0, "l9", 1.0)]
    (tmp_path / "b.json").write_text("[\n" + ",\n".join(map(json.dumps, rows)) + ',\n{"route": \n]\n')
    fixes, counts = files.matched_lines(spark, str(tmp_path / "b.json"))
    assert fixes.count() == 3 and tuple(counts.first()) == (2, 1)


def test_chunks_join_unless_one_is_broken(spark, tmp_path):
    for name, text in (("c0.json", '[\n{"a": 1},\n{"a": 2}\n]'), ("c1.json", '[\n{"a": 3}\n]'), ("c2.partial.json", '[\n{"a": ')):
        (tmp_path / name).write_text(text)
    assert sorted(r.a for r in sinks.concat_chunks(spark, str(tmp_path), "a long").collect()) == [1, 2, 3]
    (tmp_path / "c3.json").write_text('[\n{"a": \n')
    with pytest.raises(Exception, match="broken chunk"):
        sinks.concat_chunks(spark, str(tmp_path), "a long").collect()


def test_graph_json_keeps_the_order_of_links(spark, tmp_path):
    (tmp_path / "g.json").write_text(json.dumps({"links": {"z": {"speed": 3.0}, "a": {"speed": 4.0, "lanes": 2.0}}, "adjacency": {"z": ["a", "a"], "a": []}}))
    links, adjacency = files.graph_json(spark, str(tmp_path / "g.json"))
    assert [tuple(r) for r in links.orderBy("link_idx").collect()] == [("z", 0, 3.0, None), ("a", 1, 4.0, 2.0)]
    assert [tuple(r) for r in adjacency.orderBy("pos").collect()] == [("z", 0, "a"), ("z", 1, "a")]


def test_network_xml(spark, tmp_path):
    (tmp_path / "n.xml").write_text('<network><nodes><node id="1" x="-111.9" y="40.7"/><node id="2" x="-111.8" y="40.7"/></nodes><links><link id="a" from="1" to="2" length="5" freespeed="11.5" permlanes="2" modes="car,bus"/><link id="b" from="2" to="1" length="5" freespeed="1" permlanes="1" modes="bike"/><link id="c" from="2" to="7" length="5" freespeed="1" permlanes="1" modes="car"/></links></network>')
    nodes, links = files.network_xml(spark, str(tmp_path / "n.xml"))
    assert nodes.count() == 2 and [(r.link_id, r.speed, r.lanes) for r in links.collect()] == [("a", 11.5, 2.0)]
    assert [(r.lon1, r.lon2) for r in files.link_lines(nodes, links).collect()] == [(-111.9, -111.8)]


def test_npz_matrices(spark, tmp_path):
    m = np.array([[0, 2, 0], [1, 0, 3]])
    np.savez(tmp_path / "s.npz", matrix_data=[2, 1, 3], matrix_indices=[1, 0, 2], matrix_indptr=[0, 1, 3], matrix_shape=m.shape, times=np.array(["t0", "t1"]), link_ids=np.array(["a", "b", "c"]))
    np.savez(tmp_path / "d.npz", matrix=m.astype(np.float32), times=np.array(["t0", "t1"]), link_ids=np.array(["a", "b", "c"]))
    want = [("t0", "b", 2.0), ("t1", "a", 1.0), ("t1", "c", 3.0)]
    for name in "sd":
        assert sorted(tuple(r) for r in files.npz_matrix(spark, str(tmp_path / f"{name}.npz")).collect()) == want


def test_result_files_hold_infinity(spark, tmp_path):
    (tmp_path / "r1.json").write_text('{"declared_sigma": 1.5,\n "edges": [1, Infinity]}')
    row = files.result_json(spark, str(tmp_path / "r*.json"), "declared_sigma double, edges array<double>").first()
    assert row.declared_sigma == 1.5 and row.edges == [1.0, math.inf]


def pbf(path: Path) -> None:
    """A small extract: three nodes, a drivable way against its order, a footpath."""

    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    def field(number, value):
        return varint(number << 3 | 2) + varint(len(value)) + value if isinstance(value, bytes) else varint(number << 3) + varint(value)

    def deltas(values):
        return b"".join(varint((d << 1) ^ (d >> 63)) for d in (b - a for a, b in zip([0, *values], values, strict=False)))

    strings = [b"", b"highway", b"primary", b"oneway", b"-1", b"footway"]
    nodes = field(1, deltas([5, 9, 7])) + field(8, deltas([407000000, 408000000, 500000000])) + field(9, deltas([-1119000000, -1118000000, -1118000000]))
    ways = [field(1, 77) + field(2, varint(1) + varint(3)) + field(3, varint(2) + varint(4)) + field(8, deltas([5, 9, 7])), field(1, 78) + field(2, varint(1)) + field(3, varint(5)) + field(8, deltas([5, 9]))]
    plain = field(1, 2 * 8) + field(8, 2 * 405000000) + field(9, 2 * 1115000000 - 1)  # zigzag of 8, 40.5 degrees and -111.5 degrees
    block = field(1, b"".join(field(1, x) for x in strings)) + field(2, field(2, nodes) + field(1, plain)) + field(2, b"".join(field(3, w) for w in ways))
    out = b""
    for kind, body in ((b"OSMHeader", b""), (b"OSMData", block)):
        blob = field(2, len(body)) + field(3, zlib.compress(body))
        head = field(1, kind) + field(3, len(blob))
        out += struct.pack(">I", len(head)) + head + blob
    path.write_bytes(out)


def test_osm_extract_to_directed_edges(spark, tmp_path):
    pbf(tmp_path / "x.osm.pbf")
    nodes, ways = files.osm_pbf(spark, str(tmp_path / "x.osm.pbf"), (40.0, 41.0, -112.0, -111.0))
    assert sorted((r.id, round(r.lat, 7), round(r.lon, 7)) for r in nodes.collect()) == [(5, 40.7, -111.9), (8, 40.5, -111.5), (9, 40.8, -111.8)]
    assert [(r.way_id, r.nodes, r.oneway) for r in ways.collect()] == [(77, [5, 9, 7], "-1")]
    assert [tuple(r) for r in network.directed_edges(ways, nodes).collect()] == [(9, 5)]


def test_sinks(spark, tmp_path):
    cells = spark.createDataFrame([(0, 1, 2.0), (86_400, 2, 3.0)], "slot long, link_id long, c double")
    sinks.write_matrix(cells, str(tmp_path / "m"))
    assert len(list((tmp_path / "m").glob("bin_date=*"))) == 2
    assert spark.read.parquet(str(tmp_path / "m")).where("bin_date = DATE '1970-01-02'").select("link_id").first()[0] == 2
    sinks.write_vector(spark.createDataFrame([("a", 0.5)], "link_id string, v double"), str(tmp_path / "v"))
    assert spark.read.json(str(tmp_path / "v")).first().asDict() == {"link_id": "a", "v": 0.5}


# Streams


def test_streams_give_what_batches_give(spark, tmp_path):
    rows = [(f"2024-01-01 00:0{m}:{s:02d}", k % 3, k % 5) for k, (m, s) in enumerate((m, s) for m in range(9) for s in (0, 20, 40))]
    d = spark.createDataFrame(rows, "at string, link_id long, route_id long").select(F.col("at").cast("timestamp").alias("ts"), "link_id", "route_id")
    d.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(d.schema).parquet(str(tmp_path / "in"))
    for name, f, mode in (("popularity", live.popularity, "complete"), ("sessions", lambda x: live.sessions(x.withColumnRenamed("route_id", "did"), "2 minutes"), "complete")):
        q = f(stream).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert sorted(map(str, spark.table(name).collect())) == sorted(map(str, f(d).collect()))


def test_turns_at_a_link_without_direction_equal_their_sql(spark, tmp_path):
    """Part 362276 is a street of no length, which the small tables don't have."""
    con, d = duckdb.connect(), str(tmp_path)
    con.sql(f"COPY (SELECT unnest([1, 362276, 5])::BIGINT AS p_partkey, unnest([3, 4, 9])::INTEGER AS p_size) TO '{d}/part.parquet'")
    con.sql(f"COPY (SELECT 1::BIGINT AS l_orderkey, unnest([1, 362276, 5, 1])::BIGINT AS l_partkey, 1::BIGINT AS l_suppkey, unnest([1, 2, 3, 4])::INTEGER AS l_linenumber) TO '{d}/lineitem.parquet'")
    for name in ("part", "lineitem"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{d}/{name}.parquet'")
    for name in ("turn_cosine", "turn_angle_kernel"):
        got = sorted(map(tuple, catalog.queries()[name](spark, d).collect()))
        assert len(got) == 3 and np.allclose(got, sorted(con.execute(catalog.oracle_sql()[name]).fetchall()), atol=1e-4), name


def _walked(edges, ends, links, max_steps):
    """What ``walk_chains`` says, one walk after the other."""
    out = {}
    heads = {}
    for a, b in edges:
        heads.setdefault(a, set()).add(b)
    for start in ends:
        for first in heads.get(start, ()):
            way = [start, first]
            while way[-1] not in ends and len(way) - 2 < max_steps and len(on := heads.get(way[-1], set()) - {way[-2]}) == 1:
                way += on
            names = [k for k, u, v in links if u == start and v == way[-1] and v in ends and v != start]
            for edge in zip(way, way[1:], strict=False) if names else ():
                out[edge] = min(out.get(edge, min(names)), min(names))
    return out


def test_long_walks_take_few_rounds_and_equal_plain_ones(spark, monkeypatch):
    """Roads of 1 to 70 nodes, some with a side street, a merge, a loop, a way back to the start or a dead end."""
    r = np.random.default_rng(8)
    edges, ends, links, top = [], set(), [], 0
    for road in range(60):
        n = int(r.integers(1, 71))
        way = list(range(top, top + n + 1))
        edges += [*zip(way, way[1:], strict=False)] + ([*zip(way[1:], way, strict=False)] if road % 3 else [])
        ends |= {way[0]} if road % 11 == 0 else {way[0], way[-1]}
        links += [(2 * road, way[0], way[-1]), (2 * road + 1, way[-1], way[0]), (500 - road, way[0], way[-1])]
        some = lambda: way[int(r.integers(0, len(way)))]  # noqa: B023, E731
        edges += [[], [(some(), top + 900)], [(top + 900, some())], [(some(), some())], [(way[-1], way[0]), (some(), way[0])]][road % 5]
        ends |= {top + 900} if road % 2 else set()
        links += [(1000 + road, top + 900, way[-1])]
        top += 1000
    calls, checkpoint = [], type(spark.range(1)).checkpoint
    monkeypatch.setattr(type(spark.range(1)), "checkpoint", lambda d, *a: (calls.append(1), checkpoint(d, *a))[1])
    e, n, k = spark.createDataFrame(edges, "a long, b long"), spark.createDataFrame([(x,) for x in ends], "id long"), spark.createDataFrame(links, "link_id long, u long, v long")
    for most in (80, 7, 6, 0):
        calls.clear()
        want = _walked(edges, ends, links, most)
        assert want and {(x.a, x.b): x.link_id for x in network.walk_chains(e, n, k, most).collect()} == want
        assert len(calls) <= 9  # one a step before


def test_decoding_does_not_depend_on_batches(spark):
    """Parts of 1 to 9 pings, cut into batches anywhere, against a plain decoder of each."""
    r = np.random.default_rng(12)
    rows, want = [], {}
    for part in range(40):
        before = {}
        chain = []
        for k in range(int(r.integers(1, 10))):
            now = {}
            for link in sorted(r.choice(12, int(r.integers(1, 5)), replace=False).tolist()):
                steps = [(i, float(r.integers(0, 6))) for i in sorted(before) if r.uniform() < 0.5]
                cost = float(r.integers(0, 4))
                rows.append((part // 3, part % 3, k + 1, k, float(k), link, 0.5, cost, [i for i, _ in steps] or None, [c for _, c in steps] or None))
                ways = [(before[i][0] + c, i) for i, c in steps if np.isfinite(before[i][0])]
                now[link] = (cost + min(ways)[0], min(ways)[1]) if ways else (np.inf, None)
            if not any(np.isfinite(c) for c, _ in now.values()):
                now = {x[5]: (x[7], None) for x in rows[-len(now):]}
            chain.append(now)
            before = now
        link = None
        for k in reversed(range(len(chain))):
            link = min(chain[k], key=lambda j: (chain[k][j][0], j)) if link is None else link  # noqa: B023
            want[part // 3, part % 3, k] = (link, chain[k][link][1] is not None)
            link = chain[k][link][1]
    names = ["route_id", "part", "k", "fix_idx", "t", "link_id", "along", "cost", "srcs", "costs"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.float64())]
    table = pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
    for size in (1, 3, 17, len(rows)):
        got = [x for b in matching._decode(iter(table.combine_chunks().to_batches(size))) for x in b.to_pylist()]
        assert {(x["route_id"], x["part"], x["fix_idx"]): (x["link_id"], x["linked"]) for x in got} == want and len(got) == len(want)
    assert list(matching._decode(iter([]))) == []
