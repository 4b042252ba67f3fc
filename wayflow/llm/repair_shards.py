"""Token-id output with Re-Pair grammar compression.

Documents are range-partitioned by id, encoded, and cut into shards of bounded size.  In each shard the most frequent
adjacent id pairs are replaced by nonterminals, many pairs a round, until no pair comes ``least`` times; pairs never cross
documents.  A shard stores its rules, the expansion length of each rule, and where each document starts in the
compressed sequence, so one document is decoded without the others.

Shard bytes (little-endian): magic ``RPR1``; uint32 n_docs, terminals, n_rules, n_symbols; then arrays: doc_id int64,
null flags uint8, symbol offsets of documents uint32 (n_docs + 1), rules uint32 (n_rules, 2), expansion lengths uint32, symbols uint32 or
uint16 (flag in a fifth uint32: width in bytes).
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import id_text, read, shared_path, slices, task, tidied
from .tokens import encoder, with_end

MAGIC = b"RPR1"
SHARD_IDS = 1 << 20
END = 2


def compress(ids: np.ndarray, ends: np.ndarray, terminals: int, least: int = 8, per_round: int = 8192) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols, rules (n, 2), and the position after each document in the symbols.

    ``ends`` has the position after each document in ``ids``.  Each round counts all adjacent pairs within documents,
    gives the ``per_round`` most frequent of at least ``least`` a nonterminal (only those that reach the count of the
    2 * ``per_round``-th bucket of a hash table, which bounds each pair's count from above; others wait a round), and replaces their occurrences from left to right.
    Rounds go on until no pair comes ``least`` times.  A rule takes 12 bytes and spares a symbol of 2 or 4 each time it is used; 8
    keeps most shards below 65,536 symbols, so at 2 bytes: of a shard of 1,049,364 ids it leaves 1.25 MB, where 4 leaves 2.24.
    """
    seq, rules = ids.astype(np.uint32), []
    last = np.zeros(len(ids), bool)
    last[ends[ends > 0] - 1] = True
    keep_ends = ends.copy()
    fresh_from = 0
    while len(seq) > 1:
        inside = ~last[:-1]  # not over two documents
        if fresh_from:  # only a pair with a symbol of the last round can have become frequent
            young = seq >= fresh_from
            inside &= young[:-1] | young[1:]
        at = np.flatnonzero(inside)
        first, second = seq[at], seq[at + 1]
        hashed = ((first * np.uint32(0x9E3779B1)) ^ (second * np.uint32(0x85EBCA6B))) >> np.uint32(12)
        bucket = np.bincount(hashed, minlength=1 << 20)  # an upper bound of each pair's count
        often = bucket[bucket >= least]
        floor = int(np.partition(often, -2 * per_round)[-2 * per_round]) if len(often) > 2 * per_round else least
        likely = (bucket >= floor)[hashed]
        at, pair = at[likely], first[likely].astype(np.uint64) << np.uint64(32) | second[likely]
        coded = pa.array(pair).dictionary_encode()  # a hash table; sorting all pairs costs more
        keys, code = coded.dictionary.to_numpy(), coded.indices.to_numpy()
        count = np.bincount(code, minlength=len(keys))
        some = np.flatnonzero(count >= floor)
        if not len(some):
            break
        waiting = floor > least or len(some) > per_round
        if len(some) > per_round:
            some = some[np.lexsort((keys[some], -count[some]))[:per_round]]
        some = some[np.argsort(keys[some])]
        rank = np.full(len(keys), -1, np.int32)
        rank[some] = np.arange(len(some))
        keys, spot = keys[some], rank[code]
        hit = spot >= 0
        at, spot = at[hit], spot[hit]
        fresh = np.ones(len(at), bool)
        fresh[1:] = np.diff(at) > 1
        run = np.arange(len(at)) - np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
        take = run % 2 == 0  # of overlapping occurrences every other one
        at, spot = at[take], spot[take]
        used = np.flatnonzero(np.bincount(spot, minlength=len(keys)))
        number = np.searchsorted(used, np.arange(len(keys)))[spot]
        base = terminals + sum(map(len, rules))
        fresh_from = 0 if waiting else base
        rules.append(np.stack([keys[used] >> np.uint64(32), keys[used] & np.uint64(0xFFFFFFFF)], 1))
        seq[at] = (base + number).astype(np.uint32)
        stay = np.ones(len(seq), bool)
        stay[at + 1] = False
        last[at] |= last[at + 1]
        keep_ends = keep_ends - np.searchsorted(at + 1, keep_ends)
        seq, last = seq[stay], last[stay]
    return seq, np.concatenate([np.zeros((0, 2), np.uint64), *rules]).astype(np.uint32), keep_ends


def lengths(rules: np.ndarray, terminals: int) -> np.ndarray:
    """Expanded length of each rule; a rule only uses symbols before it."""
    out = np.ones(len(rules), np.uint32)
    for k, (a, b) in enumerate(rules.tolist()):
        out[k] = (out[a - terminals] if a >= terminals else 1) + (out[b - terminals] if b >= terminals else 1)
    return out


def expand(symbols: np.ndarray, rules: np.ndarray, terminals: int) -> np.ndarray:
    """Replace nonterminals by their pairs, last made first, until only ids are left."""
    seq = symbols.astype(np.uint32)
    while len(seq) and (seq >= terminals).any():
        big = seq >= terminals
        out = np.empty(len(seq) + int(big.sum()), np.uint32)
        at = np.arange(len(seq)) + np.concatenate([[0], np.cumsum(big)[:-1]])
        out[at] = seq
        pair = rules[seq[big] - terminals]
        out[at[big]], out[at[big] + 1] = pair[:, 0], pair[:, 1]
        seq = out
    return seq


def pack(doc_id: np.ndarray, null: np.ndarray, ids: np.ndarray, off: np.ndarray, terminals: int) -> bytes:
    """One shard's bytes."""
    symbols, rules, ends = compress(ids, off[1:], terminals)
    width = 2 if terminals + len(rules) <= 1 << 16 else 4
    head = struct.pack("<5I", len(doc_id), terminals, len(rules), len(symbols), width)
    starts = np.concatenate([[0], ends]).astype("<u4")
    return b"".join([MAGIC, head, doc_id.astype("<i8").tobytes(), null.astype("u1").tobytes(), starts.tobytes(), rules.astype("<u4").tobytes(), lengths(rules, terminals).astype("<u4").tobytes(), symbols.astype(f"<u{width}").tobytes()])


class Shard:
    """Reads a shard's bytes; ``ids(k)`` expands only document k."""

    def __init__(self, raw: bytes):
        if raw[:4] != MAGIC:
            raise ValueError("not a Re-Pair shard")
        n, self.terminals, n_rules, n_symbols, width = struct.unpack_from("<5I", raw, 4)
        at = 24

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(raw, kind, count, at)
            at += out.nbytes
            return out

        doc_id, null = take("<i8", n), take("u1", n)
        self.doc_id = [None if z else int(i) for i, z in zip(doc_id, null, strict=True)]
        self.starts = take("<u4", n + 1).astype(np.int64)
        self.rules = take("<u4", 2 * n_rules).reshape(-1, 2)
        self.rule_length = take("<u4", n_rules)
        self.symbols = take(f"<u{width}", n_symbols)

    def n_ids(self) -> np.ndarray:
        """Ids of each document, from the expansion lengths alone."""
        big = self.symbols >= self.terminals
        size = np.ones(len(self.symbols), np.int64)
        size[big] = self.rule_length[self.symbols[big].astype(np.int64) - self.terminals]
        total = np.concatenate([[0], np.cumsum(size)])
        return np.diff(total[self.starts])

    def ids(self, k: int) -> np.ndarray:
        return expand(self.symbols[self.starts[k] : self.starts[k + 1]], self.rules, self.terminals)

    def all_ids(self) -> np.ndarray:
        """Every rule is expanded once; then each symbol copies its ids."""
        n = len(self.rules)
        flat = expand(np.arange(self.terminals, self.terminals + n, dtype=np.uint32), self.rules, self.terminals)
        start = np.cumsum(self.rule_length, dtype=np.int64) - self.rule_length
        big = self.symbols >= self.terminals
        size, begin = np.ones(len(self.symbols), np.int64), len(flat) + np.cumsum(~big) - 1
        rule = self.symbols[big].astype(np.int64) - self.terminals
        size[big], begin[big] = self.rule_length[rule], start[rule]
        ends = np.cumsum(size)
        source = np.concatenate([flat, self.symbols[~big].astype(np.uint32)])
        return source[np.repeat(begin - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]


SHARDS = "part int, seq int, n_docs long, n_ids long, inner long, shard binary"
#: Partitions up to which their starts, 12 bytes each, are broadcast.
MOST_PARTS = 1 << 20


def write_shards(docs: DataFrame, path: str, tokenizer: str, end: int = END, shard_ids: int = SHARD_IDS) -> None:
    """Encode ``docs`` and write shards to ``path`` (a Parquet table of part, seq, n_docs, n_ids, inner, shard), in ascending doc_id order;
    ``inner`` counts the ids of the partition before the shard.

    Null texts are empty: they have the end id alone.  A text longer than ``shard_ids`` is a shard of its own, with those before it.
    Other columns are left out, whatever their names.  Rows with equal ids keep rows of their own, in the order of their
    texts; rows without an id come first.  An empty table writes an empty one.
    """
    rows = id_text(docs).repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, seq = encoder(tokenizer), task(), 0
        terminals = enc.tokenizer.get_vocab_size()
        held: list[tuple] = []
        size = inner = 0

        def shard() -> pa.RecordBatch:
            ids = np.concatenate([h[2] for h in held])
            off = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(h[3]) for h in held]))])
            raw = pack(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), ids, off, terminals)
            return pa.record_batch([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(off) - 1], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([inner], pa.int64()), pa.array([raw], pa.binary())], names=["part", "seq", "n_docs", "n_ids", "inner", "shard"])

        for b in slices(batches):
            ids, off = with_end(*enc.encode(b.column("text")), end)
            doc = b.column("doc_id")
            held.append((pc.fill_null(doc, 0).to_numpy(), doc.is_null().to_numpy(zero_copy_only=False), ids, off))
            size += len(ids)
            if size >= shard_ids:
                yield shard()
                seq, inner, held, size = seq + 1, inner + size, [], 0
        if held:
            yield shard()

    rows.mapInArrow(tidied(run), SHARDS).write.parquet(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """Per document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, part and seq of its shard."""
    shards = spark.read.schema(SHARDS).parquet(path)
    sums = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = sums.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("base"))  # a row for each partition of the writer
    before = F.broadcast(before) if sums.count() <= MOST_PARTS else before
    rows = shards.join(before, "part").select("part", "seq", (F.col("base") + F.col("inner")).alias("start"), "shard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, seq, start, raw in zip(*(b.column(c).to_pylist() for c in ("part", "seq", "start", "shard")), strict=True):
                s = Shard(raw)
                n = s.n_ids()
                off = np.concatenate([[0], np.cumsum(n)])
                ids = s.all_ids().astype("<u4")
                crc = [zlib.crc32(ids[a:z].tobytes()) for a, z in zip(off, off[1:], strict=False)]
                yield pa.record_batch([pa.array(s.doc_id, pa.int64()), pa.array(start + off[:-1], pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array([part] * len(n), pa.int32()), pa.array([seq] * len(n), pa.int32())], names=["doc_id", "start", "n_tokens", "ids_crc32", "part", "seq"])

    return rows.mapInArrow(tidied(run), "doc_id long, start long, n_tokens long, ids_crc32 long, part int, seq int")


def op1_repair_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = shared_path(spark, "repair")
    write_shards(read(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_shards(spark, path)


QUERIES = {"op1_repair_shards": op1_repair_shards}
SQL: dict[str, str] = {}
