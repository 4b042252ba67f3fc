"""Exact dedup through a cuckoo-filter index.

A :class:`CuckooIndex` keeps short fingerprints in a cuckoo filter and the live digests in content buckets beside it.
A filter hit is only a hint: it is verified against the bucketed content (the whole digest), so no two different texts
ever meet.  Digests can be deleted again; when a displacement chain is too long the filter is rebuilt at twice the
size from the stored keys.

At corpus scale there are two levels of the same index.  Each scan task keeps one of bounded size, which folds the
copies that it sees before anything is shuffled, so one text with a third of all rows costs a row a task.  What is left
goes to shards by digest, and each shard's index folds it for good.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_text, read, slices, stored, tidied

SPACE = b" \t\n\x0b\x0c\r"


class CuckooIndex:
    """Insertion, lookup and deletion of live 32-byte digests, each with one value."""

    SLOTS, KICKS = 4, 200

    def __init__(self, buckets: int = 1024):
        self.resizes = -1
        self.size = 0
        self._content: dict[int, dict[bytes, object]] = {}
        self._build(1 << max(1, (buckets - 1).bit_length()))

    def _build(self, buckets: int) -> None:
        """A filter of this size with the fingerprints of all stored keys, or a larger one if they don't fit."""
        keys = [k for bucket in self._content.values() for k in bucket]
        values = {k: v for bucket in self._content.values() for k, v in bucket.items()}
        while True:
            self.resizes += 1
            self._mask, self._filter, self._content = buckets - 1, [[] for _ in range(buckets)], {}
            if all(self._place(k) for k in keys):
                break
            buckets *= 2
        for k in keys:
            self._content.setdefault(self._home(k)[1], {})[k] = values[k]

    def _home(self, digest: bytes) -> tuple[int, int]:
        """Fingerprint (never 0) and first bucket, from different bytes of the digest."""
        return (digest[0] | digest[1] << 8) or 1, int.from_bytes(digest[2:10], "little") & self._mask

    def _other(self, fingerprint: int, bucket: int) -> int:
        return bucket ^ (fingerprint * 0x5BD1E995 & self._mask)

    def _place(self, digest: bytes) -> bool:
        fp, i = self._home(digest)
        j = self._other(fp, i)
        for at in (i, j):
            if len(self._filter[at]) < self.SLOTS:
                self._filter[at].append(fp)
                return True
        at = i
        for k in range(self.KICKS):
            slot = (fp + k) % self.SLOTS
            fp, self._filter[at][slot] = self._filter[at][slot], fp
            at = self._other(fp, at)
            if len(self._filter[at]) < self.SLOTS:
                self._filter[at].append(fp)
                return True
        return False

    def maybe(self, digest: bytes) -> bool:
        """The filter's answer: false means absent, true needs verification."""
        fp, i = self._home(digest)
        return fp in self._filter[i] or fp in self._filter[self._other(fp, i)]

    def get(self, digest: bytes) -> object | None:
        return self._content.get(self._home(digest)[1], {}).get(digest) if self.maybe(digest) else None

    def put(self, digest: bytes, value: object) -> None:
        """Insert, or replace the value of a live digest."""
        bucket = self._home(digest)[1]
        if self.maybe(digest) and digest in self._content.get(bucket, ()):
            self._content[bucket][digest] = value
            return
        placed = self._place(digest)  # a failed placement leaves another key's fingerprint out: rebuild from the keys
        self._content.setdefault(bucket, {})[digest] = value
        self.size += 1
        if not placed:
            self._build(2 * (self._mask + 1))

    def delete(self, digest: bytes) -> bool:
        """Remove a live digest; others that share its fingerprint stay."""
        if self.get(digest) is None:
            return False
        fp, i = self._home(digest)
        at = i if fp in self._filter[i] else self._other(fp, i)
        self._filter[at].remove(fp)
        del self._content[i][digest]
        self.size -= 1
        return True

    def items(self) -> Iterator[tuple[bytes, object]]:
        for bucket in self._content.values():
            yield from bucket.items()


def normal_digest(text: bytes) -> bytes:
    """sha256 of the text without [\\x20\\x09-\\x0D]; no other UTF-8 character has these bytes."""
    return hashlib.sha256(text.translate(None, SPACE)).digest()


FOLDED = pa.schema([("digest", pa.binary()), ("n_chars", pa.int64()), ("doc_id", pa.int64()), ("rows", pa.int64())])
#: Live digests that a scan task folds before it hands them on: bounds its memory.
TASK_KEYS = 200_000


def _better(a: tuple, b: tuple) -> bool:
    """More code points, then the smaller id; a null id comes last."""
    return (-a[0], a[1] is None, a[1] or 0) < (-b[0], b[1] is None, b[1] or 0)


def _fold(index: CuckooIndex, digest: bytes, n_chars: int, doc_id: int | None, rows: int) -> None:
    old = index.get(digest)
    new = (n_chars, doc_id)
    if old is None:
        index.put(digest, (n_chars, doc_id, rows))
    else:
        index.put(digest, (*(new if _better(new, old) else old[:2]), old[2] + rows))


def _rows(index: CuckooIndex) -> pa.RecordBatch:
    got = list(index.items())
    return pa.record_batch([pa.array([k for k, _ in got], pa.binary()), *(pa.array([v[c] for _, v in got], pa.int64()) for c in range(3))], schema=FOLDED)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        text = b.column("text")
        out = [normal_digest(x.as_py()) for x in text.cast(pa.binary())]
        yield pa.record_batch([b.column("doc_id"), pa.array(out, pa.binary()), pc.cast(pc.utf8_length(text), pa.int64()), b.column("text_hash")], names=["doc_id", "digest", "n_chars", "text_hash"])


def _fold_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    index = CuckooIndex()
    for b in batches:
        for digest, n, i in zip(b.column("digest").to_pylist(), b.column("n_chars").to_pylist(), b.column("doc_id").to_pylist(), strict=True):
            _fold(index, digest, n, i, 1)
        if index.size >= TASK_KEYS:
            yield _rows(index)
            index = CuckooIndex()
    yield _rows(index)


def _merge_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task has whole shards; its rows come ordered by shard, so one index is open at a time."""
    index, shard = CuckooIndex(), None
    for b in batches:
        for s, *row in zip(*(b.column(c).to_pylist() for c in ("shard", "digest", "n_chars", "doc_id", "rows")), strict=True):
            if s != shard:
                if index.size:
                    yield _rows(index)
                index, shard = CuckooIndex(), s
            _fold(index, *row)
    if index.size:
        yield _rows(index)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, digest of the normalised text, code points and a hash of the original text."""
    return id_text(docs, hashed=True).mapInArrow(tidied(_digests), "doc_id long, digest binary, n_chars long, text_hash long")


def exact_groups(digested: DataFrame, shards: int = 4096) -> DataFrame:
    """One row per live digest: digest, n_chars and doc_id of the row that stays, rows.

    ``shards`` bounds one index to distinct texts / shards; raise it with the corpus."""
    folded = digested.mapInArrow(tidied(_fold_task), "digest binary, n_chars long, doc_id long, rows long")
    placed = folded.withColumn("shard", F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int"))
    return placed.repartition("shard").sortWithinPartitions("shard").mapInArrow(tidied(_merge_shards), "digest binary, n_chars long, doc_id long, rows long")


def exact_dedup(docs: DataFrame, shards: int = 4096) -> DataFrame:
    """Group documents whose texts are equal without white space.

    Per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, n_chars, text_hash.  Null texts are empty and form one group with
    blank ones.  Rows with equal ids are rows of their own in group_size; all of them that match keep_id are kept.
    Rows without an id are kept only if no row of their group has one.  An empty table gives an empty result.
    """
    digested = stored(digests(docs), "digests")
    groups = exact_groups(digested, shards).select("digest", F.col("doc_id").alias("keep_id"), F.col("rows").alias("group_size"))
    return digested.join(groups, "digest").select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), "n_chars", "text_hash")


def apply_changes(index: DataFrame | None, inserts: DataFrame, deletes: DataFrame, shards: int = 4096) -> DataFrame:
    """Next version of a stored index (digest, n_chars, doc_id, rows): ``inserts`` are documents, ``deletes`` has a column digest.

    Deletions apply to what was live before; an unknown digest is ignored.  Write the result to a new path and then
    switch to it: a lost executor only repeats its tasks.
    """
    spark = inserts.sparkSession
    fresh = digests(inserts).mapInArrow(tidied(_fold_task), "digest binary, n_chars long, doc_id long, rows long").withColumn("step", F.lit(2))
    gone = deletes.select("digest", F.lit(0).cast("long").alias("n_chars"), F.lit(None).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("rows"), F.lit(1).alias("step"))
    live = (index if index is not None else spark.createDataFrame([], "digest binary, n_chars long, doc_id long, rows long")).withColumn("step", F.lit(0))
    every = live.select("digest", "n_chars", "doc_id", "rows", "step").unionByName(gone).unionByName(fresh.select("digest", "n_chars", "doc_id", "rows", "step"))
    placed = every.withColumn("shard", F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuckoo, shard = CuckooIndex(), None
        for b in batches:
            for s, step, digest, *row in zip(*(b.column(c).to_pylist() for c in ("shard", "step", "digest", "n_chars", "doc_id", "rows")), strict=True):
                if s != shard:
                    yield _rows(cuckoo)
                    cuckoo, shard = CuckooIndex(), s
                if step == 1:
                    cuckoo.delete(digest)
                else:
                    _fold(cuckoo, digest, *row)
        yield _rows(cuckoo)

    return placed.repartition("shard").sortWithinPartitions("shard", "step").mapInArrow(tidied(run), "digest binary, n_chars long, doc_id long, rows long")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLE = """
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS chars,
                  sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, text_sha256
FROM n WINDOW w AS (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id)
"""
QUERIES = {"op5_exact_dedup": op5_exact_dedup}
SQL = {"op5_exact_dedup": ORACLE}
