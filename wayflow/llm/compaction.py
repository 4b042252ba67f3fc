"""Size-tiered compaction of immutable shards under a versioned manifest.

A store is a folder of runs (Parquet folders) and a folder of manifests ``v0000000001.json``.  Appending writes small
runs; compaction merges ``fanout`` or more runs of similar size into files of a target size.  A version becomes visible
by a rename that fails if the version exists, so readers see one version or the next.  Of two writers one fails, and tries again
on top of what the other has committed.  All data moves through DataFrame scans and writes without a shuffle.

The file system must have a rename that fails if the target exists, for two writers at once (HDFS and most cluster stores have;
a local disk only nearly, an object store without conditional writes not).  Runs that no version of the last ``retain`` names are
deleted, so a reader has that many commits of time to finish.
"""

from __future__ import annotations

import json
import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import read, shared_path


class Conflict(Exception):
    """Another writer has committed this version."""


class Gone(Exception):
    """This version's runs may have been deleted, as it is older than the last ``retain``."""


class RunStore:
    def __init__(self, spark: SparkSession, path: str, schema: StructType, fanout: int = 4, target_bytes: int = 32 << 20, least_bytes: int = 1 << 20, retain: int = 2, tries: int = 20):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self.fanout, self.target, self.least, self.retain, self.tries = fanout, target_bytes, least_bytes, retain, tries
        self._jvm = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path("").getFileSystem(self._conf)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def versions(self) -> list[int]:
        at = self._path("manifest")
        found = self._fs.listStatus(at) if self._fs.exists(at) else []
        names = [x.getPath().getName() for x in found]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """The runs of a version, the last one by default; version 0 has none.  Versions beyond the last ``retain`` are :class:`Gone`."""
        known = self.versions()
        version = (known or [0])[-1] if version is None else version
        if version == 0:
            return {"version": 0, "runs": []}
        if version not in known[-self.retain :]:
            raise Gone(version)
        return self._read(version)

    def _read(self, version: int) -> dict:
        stream = self._fs.open(self._path(f"manifest/v{version:010d}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def commit(self, runs: list[dict], after: int) -> int:
        """Make ``runs`` the version that follows ``after``, or raise :class:`Conflict`."""
        temp, final = self._path(f"manifest/.{uuid.uuid4().hex}"), self._path(f"manifest/v{after + 1:010d}.json")
        stream = self._fs.create(temp, False)
        stream.write(bytearray(json.dumps({"version": after + 1, "runs": runs}).encode()))
        stream.close()
        gateway = self.spark.sparkContext._gateway
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path("").toUri(), self._conf)
        try:
            context.rename(temp, final, gateway.new_array(getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename"), 0))
        except Exception as e:
            self._fs.delete(temp, False)
            if self._fs.exists(final):
                raise Conflict(after + 1) from e
            raise
        return after + 1

    def _delete(self, path: str) -> None:
        self._fs.delete(self._jvm.org.apache.hadoop.fs.Path(path), True)

    def _run(self, path: str, tier: int) -> dict:
        return {"path": path, "tier": tier, "bytes": self._fs.getContentSummary(self._jvm.org.apache.hadoop.fs.Path(path)).getLength()}

    def append(self, rows: DataFrame, by: F.Column | None = None) -> int:
        """Write ``rows`` as one small run, or as one run for each value of ``by``, and commit all of them as one version.

        If another writer commits first, the runs go on top of its version; if that fails too often, or at all, they are deleted.
        """
        at = f"{self.path}/runs/{uuid.uuid4().hex}"
        try:
            if by is None:
                rows.write.parquet(at)
                new = [at]
            else:
                name = next(n for k in range(len(rows.columns) + 1) if (n := f"arrival{k}") not in {c.lower() for c in rows.columns})
                rows.withColumn(name, by).write.partitionBy(name).parquet(at)
                found = self._fs.listStatus(self._jvm.org.apache.hadoop.fs.Path(at))
                new = sorted((str(x.getPath()) for x in found if x.isDirectory() and x.getPath().getName().startswith(name)), key=lambda p: (len(p), p))
            added = [self._run(path, 0) for path in new]
            for _ in range(self.tries):
                now = self.manifest()
                if not added:
                    return now["version"]
                try:
                    return self.commit([*now["runs"], *added], now["version"])
                except Conflict as e:
                    last = e
            raise last
        except BaseException:
            self._delete(at)
            raise

    def similar(self, runs: list[dict]) -> list[dict] | None:
        """``fanout`` or more runs of similar size, smallest first: each at most 1.5 times their mean, or all below the least size."""
        bucket: list[dict] = []
        for run in sorted(runs, key=lambda r: r["bytes"]):
            mean = sum(r["bytes"] for r in bucket) / len(bucket) if bucket else 0
            if bucket and not (run["bytes"] <= max(1.5 * mean, self.least)):
                if len(bucket) >= self.fanout:
                    return bucket
                bucket = []
            bucket.append(run)
            if len(bucket) == self.fanout * 2:
                return bucket
        return bucket if len(bucket) >= self.fanout else None

    def compact(self) -> int:
        """Merge until no ``fanout`` runs are of similar size.  A merge whose runs another writer has replaced is given up and chosen anew."""
        while True:
            now = self.manifest()
            some = self.similar(now["runs"])
            if some is None:
                return now["version"]
            at = f"{self.path}/runs/{uuid.uuid4().hex}"
            size = sum(r["bytes"] for r in some)
            gone = {r["path"] for r in some}
            try:
                self._scan(some).coalesce(max(1, math.ceil(size / self.target))).write.parquet(at)
                merged = self._run(at, 1 + max(r["tier"] for r in some))
                while gone <= {r["path"] for r in now["runs"]}:
                    try:
                        self.commit([r for r in now["runs"] if r["path"] not in gone] + [merged], now["version"])
                        break
                    except Conflict:
                        now = self.manifest()
                else:
                    self._delete(at)
            except BaseException:
                self._delete(at)
                raise
            self.vacuum()

    def vacuum(self) -> None:
        """Delete manifests before the last ``retain``, and the runs that only those name.  Runs that no manifest names may be a writer's, and stay."""
        known = self.versions()
        old, new = known[: -self.retain], known[-self.retain :]
        live = {r["path"] for v in new for r in self._read(v)["runs"]}
        for version in old:
            for path in {r["path"] for r in self._read(version)["runs"]} - live:
                self._delete(path)
            self._fs.delete(self._path(f"manifest/v{version:010d}.json"), False)

    def _scan(self, runs: list[dict]) -> DataFrame:
        reader = self.spark.read.schema(self.schema).option("recursiveFileLookup", "true")
        return reader.parquet(*(r["path"] for r in runs)) if runs else self.spark.createDataFrame([], self.schema)

    def snapshot(self, version: int | None = None) -> DataFrame:
        """All rows of a version."""
        return self._scan(self.manifest(version)["runs"])


def compacted(docs: DataFrame, arrivals: int = 16, path: str | None = None, **options: int) -> RunStore:
    """A store to which ``docs`` have come in ``arrivals`` batches by a hash of the id, compacted.

    Rows stay as they are, nulls, repeated rows and further columns included; rows without an id arrive together.  An
    empty table has no run.
    """
    store = RunStore(docs.sparkSession, path or shared_path(docs.sparkSession, "runs"), docs.schema, **options)
    store.append(docs, F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(arrivals)))
    store.compact()
    return store


def op6_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = compacted(read(spark, sf_dir, "documents")).snapshot()
    return rows.select("doc_id", "lang", "source", "n_chars", F.md5(F.col("text").cast("binary")).alias("text_md5"))


QUERIES = {"op6_compaction": op6_compaction}
SQL = {"op6_compaction": "SELECT doc_id, lang, source, n_chars, md5(text) AS text_md5 FROM documents"}
