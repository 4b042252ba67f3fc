"""Scans of the files that the mobility data comes in.  Each gives a DataFrame; nothing is read on the driver."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayflow.sources.lines import json_lines

PINGS = "did string, ts string, lat double, lon double"
BASE = "2018-01-01 00:00:00"


def csv_pings(spark: SparkSession, path: str, columns: str = PINGS) -> DataFrame:
    """Headerless CSV of device, time, latitude, longitude and whatever follows: did, ts, lat, lon, file, seq (the order in the file), us, time_sec.

    Times that can't be read, and absent coordinates, are null (``trips.valid`` drops them); time_sec counts from 2018.  Columns
    beyond the fourth are left out.
    """
    rows = spark.read.schema(columns).option("mode", "PERMISSIVE").csv(path)
    ts = F.try_to_timestamp("ts", F.lit("yyyy-MM-dd HH:mm:ss"))
    rows = rows.select("did", ts.alias("ts"), "lat", "lon", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    # The block has its place in the file, and the task's row number follows the order in a block.
    order = F.struct("block", F.col("at").bitwiseAND(F.lit((1 << 33) - 1)).alias("at"))
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return rows.select("did", "ts", "lat", "lon", "file", order.alias("seq"), us.alias("us"), F.floor((us - F.unix_micros(F.lit(BASE).cast("timestamp"))) / 1_000_000).cast("long").alias("time_sec"))


def parquet_trips(spark: SparkSession, path: str) -> DataFrame:
    """One row a trip: route_id and its pings (time_sec, lat, lon) in order.  A trip is whole wherever its rows lie."""
    rows = spark.read.parquet(path).select(F.col("route_id").cast("long").alias("route_id"), F.struct(F.col("time_sec").cast("long").alias("time_sec"), "lat", "lon").alias("ping"))
    return rows.groupBy("route_id").agg(F.sort_array(F.collect_list("ping")).alias("pings"))


def of_trips(rows: DataFrame, ids: DataFrame, by: str = "route_id") -> DataFrame:
    """Rows of the trips in ``ids``: a semi join, which Spark broadcasts if the ids are few."""
    return rows.join(ids.select(by).distinct(), by, "left_semi")


FIXES = "route struct<route_id:long, fixes:array<array<string>>, routelinks:array<array<string>>>"


def matched_fixes(rows: DataFrame) -> DataFrame:
    """(route_id, fix_idx, link_id, t) of matched trips; where fixes are absent or empty, those of the older ``routelinks`` stand."""
    some = F.when(F.size("route.fixes") > 0, F.col("route.fixes")).otherwise(F.col("route.routelinks"))
    return rows.select("route.route_id", F.posexplode(some).alias("fix_idx", "f")).select("route_id", "fix_idx", F.col("f")[0].alias("link_id"), F.expr("try_cast(f[1] AS double)").alias("t"))


def json_array(spark: SparkSession, path: str, schema: str = FIXES) -> DataFrame:
    """Objects of files that are one JSON array each, however they are broken into lines."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def matched_lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Matched trips of files with one object a line, and the numbers of good and bad lines."""
    rows = json_lines(spark, path, FIXES)
    counts = rows.agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"))
    return matched_fixes(rows.where("good").select("row.*")), counts


GRAPH = "links map<string, struct<speed:double, lanes:double>>, adjacency map<string, array<string>>"


def graph_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Links (link_id, link_idx, speed, lanes) in the order of the file, and adjacency (src, pos, dst), of a graph that is one JSON object."""
    g = spark.read.text(path, wholetext=True).select(F.from_json("value", GRAPH).alias("g"))
    links = g.select(F.posexplode(F.map_entries("g.links")).alias("link_idx", "e")).select(F.col("e.key").alias("link_id"), "link_idx", "e.value.speed", "e.value.lanes")
    adjacency = g.select(F.explode(F.map_entries("g.adjacency")).alias("e")).select(F.col("e.key").alias("src"), F.posexplode("e.value").alias("pos", "dst"))
    return links, adjacency


def network_xml(spark: SparkSession, path: str, mode: str = "car") -> tuple[DataFrame, DataFrame]:
    """Nodes (id, lon, lat) and links (link_id, u, v, length, speed, lanes, modes) of a network in XML; links whose modes hold ``mode`` and whose ends are known."""

    def tag(name: str, schema: str) -> DataFrame:
        return spark.read.format("xml").option("rowTag", name).schema(schema).load(path)

    nodes = tag("node", "_id string, _x double, _y double").select(F.col("_id").alias("id"), F.col("_x").alias("lon"), F.col("_y").alias("lat"))
    rows = tag("link", "_id string, _from string, _to string, _length double, _freespeed double, _permlanes double, _modes string")
    rows = rows.select(F.col("_id").alias("link_id"), F.col("_from").alias("u"), F.col("_to").alias("v"), F.col("_length").alias("length"), F.col("_freespeed").alias("speed"), F.col("_permlanes").alias("lanes"), F.col("_modes").alias("modes"))
    rows = rows.where(F.contains(F.coalesce("modes", F.lit("")), F.lit(mode)))
    known = nodes.select("id")
    return nodes, rows.join(known.withColumnRenamed("id", "u"), "u", "left_semi").join(known.withColumnRenamed("id", "v"), "v", "left_semi")


def link_lines(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Links with the positions of both ends: lat1, lon1, lat2, lon2."""
    end = lambda k, n: nodes.select(F.col("id").alias(n), F.col("lat").alias(f"lat{k}"), F.col("lon").alias(f"lon{k}"))
    return links.join(end(1, "u"), "u").join(end(2, "v"), "v")


def npz_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(slot, link_id, c) of npz archives with a matrix of times by links, sparse rows (data, indices, indptr) or dense; zeros are left out."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for raw in b["content"]:
                with zipfile.ZipFile(io.BytesIO(raw)) as z:
                    a = {n.removesuffix(".npy"): np.load(io.BytesIO(z.read(n)), allow_pickle=False) for n in z.namelist()}
                times, links = a["times"].astype(str), a["link_ids"].astype(str)
                if "matrix_data" in a:
                    data, at, ends = a["matrix_data"], a["matrix_indices"], a["matrix_indptr"]
                    row = np.repeat(np.arange(len(times)), np.diff(ends))
                else:
                    row, at = np.nonzero(a["matrix"])
                    data = a["matrix"][row, at]
                for k in range(0, len(data), 100_000):
                    s = slice(k, k + 100_000)
                    out = pd.DataFrame({"slot": times[row[s]], "link_id": links[at[s]], "c": data[s].astype(float)})
                    yield out[out["c"] != 0]

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(read, "slot string, link_id string, c double")


def result_json(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Result records, one JSON object a file, over a glob; Infinity and NaN are numbers."""
    reader = spark.read.option("multiLine", True).option("allowNonNumericNumbers", True)
    return (reader.schema(schema) if schema is not None else reader).json(path)


def _varint(raw: bytes, at: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        b = raw[at]
        at += 1
        out |= (b & 127) << shift
        if b < 128:
            return out, at
        shift += 7


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Fields of a protocol-buffer message: number and value."""
    at = 0
    while at < len(raw):
        tag, at = _varint(raw, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(raw, at)
        elif kind == 2:
            size, at = _varint(raw, at)
            value, at = raw[at : at + size], at + size
        else:
            size = {1: 8, 5: 4}[kind]
            value, at = raw[at : at + size], at + size
        yield tag >> 3, value


def _packed(raw: bytes, signed: bool = False) -> np.ndarray:
    """Packed integers; signed ones are zigzag differences of successive values."""
    data = np.frombuffer(raw, np.uint8)
    ends = np.flatnonzero(data < 128)
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    shift = (np.arange(len(data)) - np.repeat(starts, ends - starts + 1)) * 7
    value = np.add.reduceat((data & 127).astype(np.uint64) << shift.astype(np.uint64), starts) if len(ends) else np.zeros(0, np.uint64)
    if not signed:
        return value.astype(np.int64)
    return np.cumsum((value >> np.uint64(1)).astype(np.int64) ^ -(value & np.uint64(1)).astype(np.int64))


def _blobs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for raw in b["content"]:
            at = 0
            while at < len(raw):
                size = int.from_bytes(raw[at : at + 4], "big")
                head = dict(_fields(raw[at + 4 : at + 4 + size]))
                at += 4 + size
                if head[1] == b"OSMData":
                    yield pd.DataFrame({"blob": [raw[at : at + head[3]]]})
                at += head[3]


def _decoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import zlib

    for b in batches:
        for raw in b["blob"]:
            blob = dict(_fields(raw))
            block = blob[1] if 1 in blob else zlib.decompress(blob[3])
            fields = list(_fields(block))
            one = {k: v for k, v in fields if k in (17, 19, 20)}
            text = [v.decode() for k, t in fields if k == 1 for n, v in _fields(t) if n == 1]
            grain, lat0, lon0 = one.get(17, 100), one.get(19, 0), one.get(20, 0)
            rows = []
            signed = lambda v: v >> 1 ^ -(v & 1)
            for kind, item in ((n, v) for k, group in fields if k == 2 for n, v in _fields(group)):
                m = {k: v for k, v in _fields(item)} if kind in (1, 2, 3) else {}
                if kind == 1:
                    rows.append(("node", signed(m[1]), (signed(m[8]) * grain + lat0) * 1e-9, (signed(m[9]) * grain + lon0) * 1e-9, None, None))
                elif kind == 2:
                    lat, lon = ((_packed(m[f], True) * grain + base) * 1e-9 for f, base in ((8, lat0), (9, lon0)))
                    rows += [("node", int(i), float(y), float(x), None, None) for i, y, x in zip(_packed(m[1], True), lat, lon, strict=True)]
                elif kind == 3:
                    tags = {text[k]: text[v] for k, v in zip(_packed(m.get(2, b"")), _packed(m.get(3, b"")), strict=True)}
                    rows.append(("way", m[1], None, None, _packed(m.get(8, b""), True).tolist(), tags))
            yield pd.DataFrame(rows, columns=["kind", "id", "lat", "lon", "nodes", "tags"])


# The tag ``highway`` of ways on which cars drive.
DRIVABLE = ("motorway", "motorway_link", "trunk", "trunk_link", "primary", "primary_link", "secondary", "secondary_link", "tertiary", "tertiary_link", "unclassified", "residential", "living_street", "service", "road")


def osm_pbf(spark: SparkSession, path: str, box: tuple[float, float, float, float] | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, lat, lon) in the box (south, north, west, east) and drivable ways (way_id, nodes, oneway) of OSM extracts.

    A file is cut into its blocks in one task (2 GB at most, Spark's bound for binary files; give several extracts beyond it), and the
    blocks are decoded in parallel.  Nodes may come dense or one by one.
    """
    blobs = spark.read.format("binaryFile").load(path).select("content").mapInPandas(_blobs, "blob binary")
    rows = blobs.repartition(spark.sparkContext.defaultParallelism).mapInPandas(_decoded, "kind string, id long, lat double, lon double, nodes array<long>, tags map<string,string>")
    nodes = rows.where("kind = 'node'").select("id", "lat", "lon")
    if box is not None:
        nodes = nodes.where(F.col("lat").between(box[0], box[1]) & F.col("lon").between(box[2], box[3]))
    ways = rows.where("kind = 'way' AND size(nodes) > 1").where(F.col("tags")["highway"].isin(*DRIVABLE))
    return nodes, ways.select(F.col("id").alias("way_id"), "nodes", F.coalesce(F.col("tags")["oneway"], F.lit("no")).alias("oneway"))
