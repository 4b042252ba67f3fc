"""Late arrivals: days of sorted Parquet files, of which only the days that late rows touch are written again.

A row's rank within its day decides its file.  Ranks are hierarchical: rows are dealt by range of (time, key), so a hot day, hour or
instant is cut into subranges of about equal size; rows are counted by day, hour and subrange; offsets are cumulated over these counts,
hours within the day and subranges within the hour; and a row's own number comes from a window within one subrange.  So no window
holds a day, and only counts are ever cumulated.

A layout is a folder ``day=D/file_no=F`` of files that hold the rows' own columns alone.  Days that change are written beside the
others first and then take the old days' places by renames.  If the driver dies between two of them, the old files of that day are
still there, in a folder ``_old-...`` of the layout.  Only days, as many as the calendar has, come to the driver.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window as W

from .common import Scratch, read, shared_path, tidied

#: 2024-04-10 00:00 in UTC, in microseconds since 1970.
LATE = 1_712_707_200_000_000
HOUR, DAY = 3_600_000_000, 86_400_000_000
FILES = 700


def micros(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970 of a timestamp column; one without a zone is in UTC."""
    zoned = dict(df.dtypes)[name] == "timestamp"
    return F.unix_micros(F.col(f"`{name}`")) if zoned else F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{name}`)")


def since(at: Column, unit: int) -> Column:
    """Whole units since 1970, rounded down; -1 for null."""
    return F.coalesce(F.floor((at - F.pmod(at, F.lit(unit))) / unit), F.lit(-1)).cast("long")


def latest(rows: DataFrame, key: str, arrived: str, cutoff: int) -> DataFrame:
    """For each key the row that arrived last among the early ones (``old``, may be null) and among all (``new``), and if that one is late.

    Early rows arrived before ``cutoff``; rows without an arrival are late, and older than any other.  Ties go to the largest row by its columns
    in order.  Rows without a key are one key.  Partial maxima make a hot key cheap.
    """
    early = F.coalesce(micros(rows, arrived) < cutoff, F.lit(False))
    row = F.struct(F.col(f"`{arrived}`").alias("arrived"), (~early).alias("late"), F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias("row"))
    found = rows.select(F.col(f"`{key}`").alias("key"), row.alias("all"), F.when(early, row).alias("early")).groupBy("key").agg(F.max("early").alias("old"), F.max("all").alias("new"))
    return found.select(F.col("old.row").alias("old"), F.col("new.row").alias("new"), F.col("new.late").alias("late"))


class DayLayout:
    """A folder of day files of ``size`` rows, sorted by ``time`` and ``key``, that hold the columns of ``schema`` in order."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, size: int, key: str, time: str):
        self.spark, self.path, self.schema, self.size, self.key, self.time = spark, path.rstrip("/"), schema, size, key, time
        taken = {c.lower() for c in schema.names}
        self.day, self.file_no = (next(n for k in range(len(taken) + 1) if (n := f"{name}{'_' * k}") not in taken) for name in ("day", "file_no"))
        self._jvm = spark._jvm
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def ranked(self, rows: DataFrame, scratch: Scratch) -> DataFrame:
        """``row``, ``day`` and ``rank`` (from 0 in the day) of each row.  Rows should differ in time or key; equal ones take any order."""
        at = micros(rows, self.time)
        keyed = rows.select(F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias("row"), since(at, DAY).alias("day"), F.pmod(since(at, HOUR), F.lit(24)).alias("hour"), at.alias("at"), F.col(f"`{self.key}`").alias("key"))
        # Stored, so that counting and numbering see the same subranges, also after a lost executor.
        dealt = scratch.stored(keyed.repartitionByRange("at", "key").withColumn("sub", F.spark_partition_id()), "dealt")
        counts = dealt.groupBy("day", "hour", "sub").agg(F.count("*").alias("n"))
        before = lambda *by: W.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(W.unboundedPreceding, -1)
        hours = counts.groupBy("day", "hour").agg(F.sum("n").alias("n"))
        hours = hours.select("day", "hour", F.coalesce(F.sum("n").over(before("day", "hour")), F.lit(0)).alias("hours"))
        subs = counts.select("day", "hour", "sub", F.coalesce(F.sum("n").over(before("day", "hour", "sub")), F.lit(0)).alias("subs"))
        offsets = subs.join(hours, ["day", "hour"]).select("day", "hour", "sub", (F.col("hours") + F.col("subs")).alias("offset"))
        own = F.row_number().over(W.partitionBy("day", "hour", "sub").orderBy("at", "key")).alias("own")
        return dealt.select("row", "day", "hour", "sub", own).join(offsets, ["day", "hour", "sub"]).select("row", "day", (F.col("offset") + F.col("own") - 1).alias("rank"))

    def _write(self, rows: DataFrame, path: str) -> None:
        with Scratch(self.spark) as scratch:
            ranked = self.ranked(rows, scratch)
            placed = ranked.select("row.*", F.col("day").alias(self.day), F.floor(F.col("rank") / self.size).cast("long").alias(self.file_no))
            by = [f"`{c}`" for c in (self.day, self.file_no)]
            placed.repartition(*by).sortWithinPartitions(*by, f"`{self.time}`", f"`{self.key}`").write.partitionBy(self.day, self.file_no).option("maxRecordsPerFile", 0).parquet(path)

    def create(self, rows: DataFrame) -> None:
        self._write(rows, self.path)

    def overwrite(self, rows: DataFrame, days: list[int]) -> None:
        """Make ``rows`` all that the given days have; a day without rows goes.  Files of other days aren't touched."""
        new, old = f"_new-{uuid.uuid4().hex}", f"_old-{uuid.uuid4().hex}"
        self._write(rows, f"{self.path}/{new}")
        self._fs.mkdirs(self._at(old))
        for name in (f"{self.day}={d}" for d in days):
            for a, z in ((name, f"{old}/{name}"), (f"{new}/{name}", name)):
                if self._fs.exists(self._at(a)) and not self._fs.rename(self._at(a), self._at(z)):
                    raise OSError(f"can't rename {a} to {z} in {self.path}")
        for name in (new, old):
            self._fs.delete(self._at(name), True)

    def rows(self) -> DataFrame | None:
        """The rows of all files with their day, file_no and Spark's hidden file columns, with the columns that are in the files; None without files."""
        there = any(x.getPath().getName().startswith(f"{self.day}=") for x in self._fs.listStatus(self._at("")))
        return self.spark.read.parquet(self.path) if there else None


def write_with_late(rows: DataFrame, path: str, size: int, key: str, time: str, arrived: str, cutoff: int) -> tuple[DayLayout, list[int]]:
    """Lay out the early rows in the new folder ``path``, then bring in the late ones; the layout and the days written again.

    A layout has the row of each key that arrived last.  A day is written again if a late row that stays stands there or its key stood there
    before.  Null times are day -1; null keys are one key; ties and rows without an arrival as :func:`latest` says.  Other columns stay, whatever their
    names (partition folders take free ones); texts in them may be long.  An empty table gives an empty folder.
    """
    spark = rows.sparkSession
    with Scratch(spark) as scratch:
        kept = scratch.stored(latest(rows, key, arrived, cutoff), "kept")
        layout = DayLayout(spark, path, rows.schema, size, key, time)
        layout.create(kept.where("old IS NOT NULL").select("old.*"))
        late = kept.where("late")
        day = lambda df: df.select(since(micros(df, time), DAY).alias("day"))
        touched = day(late.select("new.*")).unionByName(day(late.where("old IS NOT NULL").select("old.*"))).distinct()
        days = sorted(r.day for r in touched.collect())  # as many as the calendar has
        now = kept.select("new.*")
        layout.overwrite(now.where(since(micros(now, time), DAY).isin(days)), days)
    return layout, days


def file_digests(rows: DataFrame, ids: Column, sums: dict[str, Column], by: tuple[str, ...]) -> DataFrame:
    """Per file its path, the columns ``by`` (which are one value a file), n_rows, sums of whole numbers, and the sha256 of the ids in the file's order, joined by commas.

    A task reads a file's rows in order and keeps nothing but the digest so far.
    """
    cols = [F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("row_index"), F.coalesce(ids.cast("string"), F.lit("")).alias("id")]
    flat = rows.select(*cols, *(F.col(f"`{c}`").cast("long").alias(f"by{k}") for k, c in enumerate(by)), *(c.cast("long").alias(f"sum{k}") for k, c in enumerate(sums.values())))
    ordered = flat.repartition("path").sortWithinPartitions("path", "row_index")
    fields, many = ["path", *by, "n_rows", *sums, "ids_sha256"], len(sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, same, n, digest = None, [], 0, hashlib.sha256()
        totals = np.zeros(many, np.int64)

        def row() -> pa.RecordBatch:
            return pa.record_batch([pa.array([x]) for x in (path, *same, n, *totals.tolist(), digest.hexdigest())], names=fields)

        for b in batches:
            if not b.num_rows:
                continue
            paths = b.column("path").dictionary_encode()
            code = paths.indices.to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(np.diff(code)) + 1).tolist(), b.num_rows]
            for a, z in zip(cuts, cuts[1:], strict=False):
                now = paths.dictionary[int(code[a])].as_py()
                if now != path:
                    if path is not None:
                        yield row()
                    path, n, digest = now, 0, hashlib.sha256()
                    same = [b.column(f"by{k}")[a].as_py() for k in range(len(by))]
                    totals[:] = 0
                text = ",".join(b.column("id").slice(a, z - a).to_pylist())
                digest.update((("," if n else "") + text).encode())
                n += z - a
                totals += np.array([b.column(f"sum{k}").slice(a, z - a).to_numpy(zero_copy_only=False).sum() for k in range(many)], np.int64)
        if path is not None:
            yield row()

    kinds = ", ".join(f"`{c}` {'string' if c in ('path', 'ids_sha256') else 'long'}" for c in fields)
    return ordered.mapInArrow(tidied(run), kinds)


def arrivals(sales: DataFrame) -> DataFrame:
    """``sales``, and for a third of the sales of every seventh day a later copy: a unit dearer, sold up to a day and arrived up to 97 days later."""
    h = F.crc32(F.coalesce(F.col("sale_id").cast("string"), F.lit("")).cast("binary"))
    later = lambda c, days: F.col(c) + F.make_dt_interval(days.cast("int"))
    new = {"total": F.col("total") + 1, "sold_at": later("sold_at", h % 2), "arrived_at": later("arrived_at", 1 + h % 97)}
    row = F.struct(*(F.col(f"`{c}`") for c in sales.columns))
    copy = F.struct(*(new.get(c, F.col(f"`{c}`")).cast(t).alias(c) for c, t in sales.dtypes))
    again = (h % 3 == 0) & (since(micros(sales, "sold_at"), DAY) % 7 == 0)
    return sales.select(F.explode(F.when(again, F.array(row, copy)).otherwise(F.array(row))).alias("row")).select("row.*")


def op12_late_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    sales = read(spark, sf_dir, "sales")
    layout, days = write_with_late(arrivals(sales), shared_path(spark, "days"), 1 + sales.count() // FILES, "sale_id", "sold_at", "arrived_at", LATE)
    rows = layout.rows()
    if rows is None:
        return spark.createDataFrame([], "day long, file_no long, n_rows long, cents long, rows_crc long, path string, columns string, ids_sha256 string, rewritten boolean")
    number = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    crc = F.crc32(F.concat_ws(":", number(F.col("sale_id")), number(micros(rows, "sold_at")), number(micros(rows, "arrived_at"))).cast("binary"))
    sums = {"cents": F.coalesce(F.floor(100 * F.col("total") + 0.5), F.lit(0)), "rows_crc": crc}
    found = file_digests(rows, F.col("sale_id"), sums, (layout.day, layout.file_no))
    columns = ",".join(c for c in rows.columns if c not in (layout.day, layout.file_no))
    return found.select(F.col(layout.day).alias("day"), F.col(layout.file_no).alias("file_no"), "n_rows", "cents", "rows_crc", "path", F.lit(columns).alias("columns"), "ids_sha256", F.col(layout.day).isin(days).alias("rewritten"))


QUERIES = {"op12_late_days": op12_late_days}
SQL: dict[str, str] = {}
