"""Best-fit packing planned on the length histogram.

Documents become pieces of at most ``capacity`` tokens.  Only the histogram of piece lengths (``capacity`` rows at most)
reaches the driver, where best-fit decreasing runs over counts: sequences that are filled alike are one range.  Pieces
then take the planned slots by their rank within their length.  Ranks come from the task that cut the piece plus the
pieces of that length in tasks before it, so no length is ever gathered in one task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import id_text, read, slices, stored, task, tidied
from .tokens import encoder, with_end

CAPACITY, END = 2048, 0


def plan(histogram: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Slots by best-fit decreasing, and the number of sequences.

    Each row of the slots is (length, first rank, pieces, first sequence, pieces a sequence, offset): the piece of rank
    first + j goes to sequence first_sequence + j // per at offset + j % per * length.
    """
    ranges: dict[int, list[tuple[int, int]]] = {}  # room left: ranges of sequences (first, count)
    rows, sequences = [], 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            room = next((r for r in range(length, capacity + 1) if ranges.get(r)), None)
            if room is None:
                room, first, count = capacity, sequences, -(-left // (capacity // length))
                sequences += count
            else:
                first, count = ranges[room].pop()
            per = room // length
            full = min(count, left // per)
            if full:
                rows.append((length, rank, full * per, first, per, capacity - room))
                ranges.setdefault(room - per * length, []).append((first, full))
                rank, left, first, count = rank + full * per, left - full * per, first + full, count - full
            if count and left and left < per:
                rows.append((length, rank, left, first, left, capacity - room))
                ranges.setdefault(room - left * length, []).append((first, 1))
                rank, left, first, count = rank + left, 0, first + 1, count - 1
            if count:
                ranges.setdefault(room, []).append((first, count))
    return np.array(rows, np.int64).reshape(-1, 6), sequences


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END, with_ids: bool = False) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, the task that cut it and its rank there within its length; ids (uint32 bytes) on demand."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(tokenizer), task()
        seen = np.zeros(capacity + 1, np.int64)
        for b in slices(batches):
            ids, off = with_end(*enc.encode(b.column("text")), end)
            n = np.diff(off)
            many = -(-n // capacity)
            doc = np.repeat(np.arange(len(n)), many)
            piece = np.arange(len(doc)) - np.repeat(np.concatenate([[0], np.cumsum(many)[:-1]]), many)
            start = piece * capacity
            length = np.minimum(n[doc] - start, capacity)
            order = np.argsort(length, kind="stable")
            total = np.bincount(length, minlength=capacity + 1)
            rank = np.empty(len(doc), np.int64)
            rank[order] = np.arange(len(doc)) - np.repeat(np.concatenate([[0], np.cumsum(total)[:-1]]), total)
            rank += seen[length]
            seen += total
            at = off[:-1][doc] + start
            raw = [ids[a : a + k].astype("<u4").tobytes() for a, k in zip(at, length, strict=True)]
            columns = [b.column("doc_id").take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array([zlib.crc32(x) for x in raw], pa.int64()), pa.array(np.full(len(doc), part), pa.int32()), pa.array(rank)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"]
            yield pa.record_batch([*columns, pa.array(raw, pa.binary())] if with_ids else columns, names=[*names, "ids"] if with_ids else names)

    return id_text(docs).mapInArrow(tidied(run), "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long" + ", ids binary" * with_ids)


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END, with_ids: bool = False) -> DataFrame:
    """Pieces with sequence_id and offset; each sequence is gapless from 0 and holds at most ``capacity`` tokens.

    Null and empty texts are a piece of the end id alone.  Rows with equal ids are packed each for itself, also those
    without an id.  An empty table gives an empty result.
    """
    cut = stored(pieces(docs, tokenizer, capacity, end, with_ids), "pieces")
    counts = cut.groupBy("part", "length").agg((F.max("rank") + 1).alias("n"))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots, _ = plan(histogram, capacity)
    shared = docs.sparkSession.sparkContext.broadcast(slots[np.lexsort((slots[:, 1], slots[:, 0]))])  # a few rows for each length
    before = counts.select("part", "length", (F.sum("n").over(W.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    ranked = cut.join(before, ["part", "length"]).withColumn("rank", F.col("rank") + F.col("before")).drop("before", "part")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = shared.value
        key = slots[:, 0] << 40 | slots[:, 1]
        for b in batches:
            if not b.num_rows:
                continue
            length, rank = (b.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            row = slots[np.searchsorted(key, length << 40 | rank, "right") - 1]
            j = rank - row[:, 1]
            t = pa.Table.from_batches([b]).drop_columns(["rank"])
            t = t.append_column("sequence_id", pa.array(row[:, 3] + j // row[:, 4])).append_column("offset", pa.array(row[:, 5] + j % row[:, 4] * length))
            yield from t.to_batches()

    kinds = dict(ranked.dtypes)
    out = ", ".join(f"{c} {kinds[c]}" for c in ranked.columns if c != "rank") + ", sequence_id bigint, offset bigint"
    return ranked.mapInArrow(tidied(place), out)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = pack(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


QUERIES = {"op7_best_fit_packing": op7_best_fit_packing}
SQL: dict[str, str] = {}
