"""Late arrivals against a plain version: small tables with nulls, ties, hot days and clashing names, and the query on given rows."""

import datetime as dt
import glob
import hashlib
import os
import random
import zlib

import duckdb
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from wayflow.llm import late_days

SF = "/root/testdata/sf0.001"
EPOCH = dt.datetime(1970, 1, 1)
CUT = EPOCH + dt.timedelta(microseconds=late_days.LATE)
SCHEMA = "sale_id long, client_id long, status string, total double, sold_at timestamp_ntz, arrived_at timestamp_ntz, day string, Row string"


def us(t):
    return None if t is None else (t - EPOCH) // dt.timedelta(microseconds=1)


def day(t):
    return -1 if t is None else (t - EPOCH).days


def layout(rows, size, key, time):
    """{(day, file_no): rows in order}"""
    days = {}
    for r in rows:
        days.setdefault(day(r[time]), []).append(r)
    order = lambda r: tuple((x is not None, x if x is not None else 0) for x in (us(r[time]), r[key]))
    out = {}
    for d, some in days.items():
        some.sort(key=order)
        out |= {(d, k // size): some[k : k + size] for k in range(0, len(some), size)}
    return out


def plain(rows, size, key=0, time=4, arrived=5):
    """The final layout, and the days written again."""
    early = lambda r: r[arrived] is not None and r[arrived] < CUT
    rank = lambda r: ((r[arrived] is not None, us(r[arrived]) or 0), not early(r), tuple((x is not None, x if x is not None else 0) for x in r))

    def kept(some):
        best = {}
        for r in some:
            if r[key] not in best or rank(r) > rank(best[r[key]]):
                best[r[key]] = r
        return best

    old, new = kept([r for r in rows if early(r)]), kept(rows)
    days = {day(r[time]) for r in new.values() if not early(r)} | {day(old[k][time]) for k, r in new.items() if not early(r) and k in old}
    return layout(new.values(), size, key, time), layout(old.values(), size, key, time), days


def read_files(path, name="day"):
    out = {}
    for f in glob.glob(f"{path}/{name}=*/*/*.parquet"):
        at = tuple(int(p.split("=")[1]) for p in f.split("/")[-3:-1])
        assert at not in out
        out[at] = pq.ParquetFile(f).read()
    return out


def rows_of(n=900, seed=3):
    r = random.Random(seed)
    start = dt.datetime(2024, 4, 1)
    noon = dt.datetime(2024, 4, 6, 12)
    rows = []
    for k in range(n):
        sold = None if r.random() < 0.05 else noon if r.random() < 0.3 else start + dt.timedelta(seconds=r.randrange(12 * 86400), microseconds=r.randrange(3))
        arrived = None if r.random() < 0.03 else start + dt.timedelta(hours=r.randrange(20 * 24))
        rows.append((None if r.random() < 0.02 else r.randrange(n // 2), r.choice([1, 1, None, k]), r.choice(["a", None, ""]), r.choice([None, 1.5, float(k)]), sold, arrived, "x" * r.choice([0, 3, 5000]), "clash"))
    return rows + rows[:9]


@pytest.mark.parametrize("size", [1, 7, 1000])
def test_layout_is_that_of_a_plain_version(spark, tmp_path, size):
    rows = rows_of()
    path = str(tmp_path / "days")
    got, days = late_days.write_with_late(spark.createDataFrame(rows, SCHEMA), path, size, "sale_id", "sold_at", "arrived_at", late_days.LATE)
    want, _, again = plain(rows, size)
    assert days == sorted(again) and got.day == "day_"
    found = read_files(path, "day_")
    assert found.keys() == want.keys()
    for at, table in found.items():
        assert table.column_names == [c.split()[0] for c in SCHEMA.split(", ")]
        assert [tuple(x.values()) for x in table.to_pylist()] == want[at]
    assert {x.split("=")[0] for x in os.listdir(path)} <= {"day_", "_SUCCESS", "._SUCCESS.crc"}


def test_other_files_keep_their_bytes(spark, tmp_path):
    rows = rows_of(300)
    df = spark.createDataFrame(rows, SCHEMA)
    path = str(tmp_path / "days")
    kept = late_days.latest(df, "sale_id", "arrived_at", late_days.LATE)
    lay = late_days.DayLayout(spark, path, df.schema, 5, "sale_id", "sold_at")
    lay.create(kept.where("old IS NOT NULL").select("old.*"))
    before = {f: open(f, "rb").read() for f in glob.glob(f"{path}/day_=*/*/*.parquet")}
    _, old, _ = plain(rows, 5)
    assert read_files(path, "day_").keys() == old.keys()
    days = sorted(d for d, _ in old)[:3]
    lay.overwrite(df.limit(0), days)
    after = {f: open(f, "rb").read() for f in glob.glob(f"{path}/day_=*/*/*.parquet")}
    assert after == {f: x for f, x in before.items() if not any(f"day_={d}/" in f for d in days)} and len(after) < len(before)


def test_ranks_count_rows_of_a_hot_instant(spark):
    from wayflow.llm.common import Scratch

    instant = dt.datetime(2024, 4, 6, 12)
    rows = [(k, None, None, None, instant if k % 3 else None, None, None, None) for k in range(3000)]
    df = spark.createDataFrame(rows, SCHEMA)
    lay = late_days.DayLayout(spark, "/tmp/none", df.schema, 5, "sale_id", "sold_at")
    with Scratch(spark) as scratch:
        got = [(r.day, r["rank"], r["id"]) for r in lay.ranked(df, scratch).select("day", "rank", F.col("row.sale_id").alias("id")).collect()]
        assert scratch.paths
    for d, ids in ((-1, range(0, 3000, 3)), (day(instant), [k for k in range(3000) if k % 3])):
        assert [i for _, _, i in sorted(x for x in got if x[0] == d)] == list(ids)
        assert sorted(x[1] for x in got if x[0] == d) == list(range(len(ids)))


def test_empty_table(spark, tmp_path):
    path = str(tmp_path / "days")
    lay, days = late_days.write_with_late(spark.createDataFrame([], SCHEMA), path, 1, "sale_id", "sold_at", "arrived_at", late_days.LATE)
    assert days == [] and lay.rows() is None and not read_files(path, "day_")


def test_zoned_times_are_utc(spark):
    df = spark.sql("SELECT TIMESTAMP '2024-04-06 23:59:59.5 UTC' AS a, TIMESTAMP_NTZ '2024-04-06 23:59:59.5' AS b, TIMESTAMP_NTZ '1969-12-31 23:00:00' AS c, CAST(NULL AS TIMESTAMP_NTZ) AS d")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        got = df.select(*(late_days.since(late_days.micros(df, c), late_days.DAY).alias(c) for c in "abcd")).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert tuple(got) == (19819, 19819, -1, -1)


def test_query_is_that_of_a_plain_version(spark):
    base = duckdb.sql(f"SELECT * FROM '{SF}/sales.parquet'").fetchall()
    rows = list(base)
    for r in base:
        h = zlib.crc32(str(r[0]).encode())
        if h % 3 == 0 and day(r[4]) % 7 == 0:
            rows.append((*r[:3], None if r[3] is None else r[3] + 1, r[4] + dt.timedelta(days=h % 2), r[5] and r[5] + dt.timedelta(days=1 + h % 97), *r[6:]))
    size = 1 + len(base) // 700
    want, old, days = plain(rows, size)
    got = {(r.day, r.file_no): r for r in late_days.op12_late_days(spark, SF).collect()}
    assert got.keys() == want.keys() and days and {d for d, _ in old} - days
    text = lambda x: "" if x is None else str(x)
    for at, some in want.items():
        r = got[at]
        table = pq.ParquetFile(r.path.removeprefix("file:")).read()
        assert [tuple(x.values()) for x in table.to_pylist()] == some and ",".join(table.column_names) == r.columns
        cents = sum(int((100 * x[3] + 0.5) // 1) if x[3] is not None else 0 for x in some)
        crc = sum(zlib.crc32(f"{text(x[0])}:{text(us(x[4]))}:{text(us(x[5]))}".encode()) for x in some)
        ids = hashlib.sha256(",".join(text(x[0]) for x in some).encode()).hexdigest()
        assert (r.n_rows, r.cents, r.rows_crc, r.ids_sha256, r.rewritten) == (len(some), cents, crc, ids, at[0] in days)
