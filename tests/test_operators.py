from pyspark.sql import functions as F

from wayflow.operators import graph, network, stats, trips
from wayflow.operators.trips import binned_means
from wayflow.plans import catalog
from wayflow.sources.lines import json_lines


def test_diffusion_by_hand(spark):
    dense = spark.createDataFrame([(0, "a", 2.0), (0, "b", 1.0), (0, "c", 0.0)], "slot int, link_id string, c double")
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "c")], "src string, dst string")
    got = {r.link_id: r.p for r in graph.diffuse(dense, graph.kernel(edges), 0.5).collect()}
    assert [round(got[k], 9) for k in "abc"] == [round(1.25 / 1.75, 9), round(0.5 / 1.75, 9), 0.0]


def test_surgery_by_hand(spark):
    v = spark.createDataFrame([(0, "a", 0.2), (0, "b", 0.3), (0, "c", 0.5)], "slot int, link_id string, v double")
    moved = {r.link_id: round(r.v, 9) for r in graph.redistribute(v, F.expr("link_id = 'a'"), F.expr("link_id = 'b'")).collect()}
    assert moved == {"a": 0.0, "b": 0.5, "c": 0.5}
    psi = {r.link_id: round(r.v, 9) for r in graph.transfer(v, F.expr("link_id = 'b'"), 0.07).collect()}
    assert psi == {"a": 0.18, "b": 0.37, "c": 0.45}


def test_gap_of_exactly_the_limit_stays(spark):
    p = spark.createDataFrame([(1, 1, 0), (1, 2, 300_000_000), (1, 3, 601_000_000)], "did int, seq int, us long")
    assert [r.trip for r in trips.sessionize(p).orderBy("seq").collect()] == [1, 1, 2]


def test_peak_ties(spark):
    links = spark.createDataFrame([(k, float(s), 1.0) for k, s in enumerate((1, 5, 5, 1))], "link_id int, speed double, lanes double")
    path = spark.createDataFrame([(9, k, k) for k in range(4)] + [(8, k, k) for k in range(2)], "route_id int, link_id int, pos int")
    assert [(r.route_id, r.l_up, r.l_down) for r in trips.phase_split(path, links).collect()] == [(9, 1, 2)]


def test_histogram_edges(spark):
    d = spark.createDataFrame([(0.25,), (49.9,), (50.0,), (50.01,)], "d double")
    assert {r.bin: r.n for r in stats.histogram(d).collect()} == {1: 1, 199: 2, -1: 1}


def test_json_lines(spark, tmp_path):
    (tmp_path / "a.json").write_text('[\n{"a": 1},\n{"a": 2} ,\n{"a": \n]\n')
    rows = json_lines(spark, str(tmp_path / "a.json"), "a long").collect()
    assert sorted(r.row.a for r in rows if r.good) == [1, 2]
    assert sum(not r.good for r in rows) == 1


def test_binned_means(spark):
    df = spark.createDataFrame([(3, 1.0, 1.0), (23, 5.0, 2.0), (4, 3.0, 1.0), (2, 9.0, 9.0)], "k long, avg_speed double, avg_lanes double")
    got = {r.bin: (r.n, r.speed) for r in binned_means(df).collect()}
    assert len(got) == 20 and got[0] == (1, 1.0) and got[1] == (1, 3.0) and got[19] == (1, 5.0) and got[7] == (0, 0.0)


def test_links_without_trips_and_unknown_nodes(spark):
    sized = spark.createDataFrame([(9, 1.0), (10, 1.0), (11, 1.0)], "link_id long, length double")
    counts = spark.createDataFrame([(9, 4), (10, 2)], "link_id long, n long")
    assert [(r.links, round(r.coverage, 9), r.mean_trips) for r in network.length_buckets(sized, counts).collect()] == [(3, 0.666666667, 2.0)]
    ways = spark.createDataFrame([(1, [97, 98, 500], "yes")], "way_id long, nodes array<long>, oneway string")
    assert [tuple(r) for r in network.directed_edges(ways, spark.range(100)).collect()] == [(97, 98)]


def test_whole_queries_keep_every_link(spark):
    sf = "/root/testdata/sf0.01"
    edges = catalog.queries()["directed_edges"](spark, sf).collect()
    assert any(max(r.a, r.b) >= 95 for r in edges)
    covered = sum(r.links * r.coverage for r in catalog.queries()["length_buckets"](spark, sf).collect())
    assert round(covered) == catalog.X.fixes(spark, sf).select("link_id").distinct().count()
