"""N-gram Jaccard join through a token-group matrix.

A document's set holds the 64-bit hashes of its distinct word n-grams.  Equal sets collapse to one representative with a key
of its own, so rows that share an id but not a text stay apart.

1.  Groups: representatives that share one of four min-hashes form a group.  Each member is compared with the group's pivot,
    exactly; links give it the pivot's label.  That is linear in the rows, however many near copies a group has.
2.  For ``percent`` p, two sets that link share one of the first n - ceil(p n / 100) + 1 tokens of each under any order of
    all tokens; the order here is by a broadcast sketch of fixed size (rough document frequency, frequent last), then by
    hash.  A token whose holders all have one label needs no more work; tokens with the same holders count once.
3.  What is left meets in blocks of a token and a range of sizes, where parity bits of hashed tokens, about as many as a set has
    tokens, bound the overlap of sets with different labels; sets that may link form groups of similar documents.
4.  Sets that the bounds can't rule out meet in cells.  There the token-group matrix works on subgroups of 32: it stores each
    subgroup's token union, bounds a query's overlap with every subgroup, and opens only those where the bound reaches p
    percent of the query's set.

Blocks and cells have a bounded size.  In a larger one the label with most members is dealt out in parts that meet the others'
parts but not one another, so thousands of near copies and a few outsiders cost their sum.  Pairs with one label are skipped,
so a block or a cell returns a spanning forest instead of all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import Scratch, added, buffers, id_text, mix, read, slices, spaced, stored, task, tidied, word_hashes

BITS, BLOCK = 20, 1 << 12
#: Bytes of text hashed at once; the arrays of a slice take some 25 times as much.
SLICE = 1 << 20


def shingle_sets(text: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-gram hashes of each text, and their offsets.  Fewer than n words are one n-gram; none is empty."""
    data, off = spaced(*buffers(text))
    start, _, h = word_hashes(data)
    first = np.searchsorted(start, off)
    words = np.diff(first)
    grams = np.where(words >= n, words - n + 1, np.minimum(words, 1))
    doc = np.repeat(np.arange(len(words)), grams)
    goff = np.concatenate([[0], np.cumsum(grams)])
    at = first[:-1][doc] + np.arange(goff[-1]) - goff[:-1][doc]
    out = np.zeros(len(at), np.uint64)
    padded = np.concatenate([h, np.zeros(n, np.uint64)])
    for k in range(n):
        inside = at + k < first[1:][doc]
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + np.where(inside, padded[at + k], np.uint64(0)) + np.uint64(k + 1))
    parts = [np.unique(out[a:z]) for a, z in zip(goff, goff[1:], strict=False)]
    return np.concatenate([np.zeros(0, np.uint64), *parts]), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)


def _bucket(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(64 - BITS)).astype(np.int64)


def frequency_levels(docs: DataFrame, n: int) -> np.ndarray:
    """One byte for each of 2**20 buckets of tokens: 0 up to twice the mean count, then a level more for each doubling.

    All documents count.  The sketch has a fixed size, so it can be broadcast at any scale; it only orders tokens.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << BITS, np.int64)
        for b in slices(batches, most=SLICE):
            total += np.bincount(_bucket(shingle_sets(b.column("text"), n)[0]), minlength=1 << BITS)
        part = task()
        for k, x in enumerate(total.reshape(-1, BLOCK)):
            if x.any():
                yield pa.record_batch([pa.array([k], pa.int32()), pa.array([part], pa.int32()), pa.array([x.tobytes()], pa.binary())], names=["block", "part", "counts"])

    count = np.zeros(1 << BITS, np.int64)
    for r in added(docs.mapInArrow(tidied(run), "block int, part int, counts binary"), ["block"]).collect():
        count[r.block * BLOCK : (r.block + 1) * BLOCK] = np.frombuffer(r.counts, np.int64)
    return np.clip(np.log2(np.maximum(count, 1) / max(count.mean(), 1)), 0, 60).astype(np.uint8)


#: Digests whose prefix a scan task remembers to have sent; more are sent again, which changes nothing.
SENT = 100_000
_ODD = np.array([0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)


def size_class(n: int) -> int:
    """Sets of 2**c to 2**(c + 1) - 1 tokens; small ones are one class."""
    return max(int(n).bit_length() - 1, 6)


def parities(tokens: np.ndarray) -> bytes:
    """Whether the tokens in each of 2 * 2**class hashed buckets are odd in number, a bit each."""
    many = 2 << size_class(len(tokens))
    return np.packbits(np.bincount((tokens % np.uint64(many)).astype(np.int64), minlength=many).astype(np.uint8) & 1).tobytes()


def digest(tokens: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums over a set; with its size they name it."""
    return tuple(int(mix(tokens ^ np.uint64(salt)).sum(dtype=np.uint64).view(np.int64)) for salt in (0, 0xA5A5A5A5A5A5A5A5))


SIGNATURE = "doc_id long, text_hash long, n long, lo long, hi long, mins array<long>, cut int, prefix array<long>, bits binary"


def signatures(docs: DataFrame, n: int, percent: int, levels: np.ndarray) -> DataFrame:
    """doc_id, n, digest of the set; and once a task and set: min-hashes, prefix tokens, of which the first ``cut`` are not frequent, parity bits."""
    shared = docs.sparkSession.sparkContext.broadcast(levels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[tuple[int, int]] = set()
        for b in slices(batches, most=SLICE):
            tokens, off = shingle_sets(b.column("text"), n)
            level = shared.value[_bucket(tokens)]
            lo, hi, mins, cut, prefix, bits = [], [], [], [], [], []
            for a, z in zip(off, off[1:], strict=False):
                t, rank = tokens[a:z], level[a:z]
                name = digest(t)
                lo.append(name[0])
                hi.append(name[1])
                if not len(t) or name in sent:
                    for column in (mins, cut, prefix, bits):
                        column.append(None)
                    continue
                if len(sent) >= SENT:
                    sent.clear()
                sent.add(name)
                size = len(t) - -(-percent * len(t) // 100) + 1
                first = np.lexsort((t, rank))[:size]
                prefix.append(t[first].view(np.int64).tolist())
                cut.append(int((rank[first] == 0).sum()))
                rare = t[rank == 0] if cut[-1] else t
                mins.append((rare[:, None] * _ODD).min(0).view(np.int64).tolist())
                bits.append(parities(t))
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.list_(pa.int64()), pa.binary()]
            yield pa.record_batch([b.column("doc_id"), b.column("text_hash"), pa.array(np.diff(off)), *(pa.array(c, k) for c, k in zip((lo, hi, mins, cut, prefix, bits), kinds, strict=True))], names=["doc_id", "text_hash", "n", "lo", "hi", "mins", "cut", "prefix", "bits"])

    return docs.mapInArrow(tidied(run), SIGNATURE)


def _against_pivot(n: int, percent: int):
    """Rows come by bin, the pivot first: links of the others to it.  Only the pivot's set is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, pivot, center = None, None, np.zeros(0, np.uint64)
        for s in slices(batches, most=SLICE):
            tokens, off = shingle_sets(s.column("text"), n)
            a, b = [], []
            for k, (at, first, key, lo, hi) in enumerate(zip(*(s.column(c).to_pylist() for c in ("bin", "label", "key", "lo", "hi")), strict=True)):
                t = tokens[off[k] : off[k + 1]]
                if first == 0:
                    if digest(t) == (lo, hi):  # else another text of the same id
                        last, pivot, center = at, key, t.copy()
                    continue
                if at != last or 100 * min(len(t), len(center)) < percent * max(len(t), len(center)):
                    continue
                spot = np.searchsorted(center, t)
                common = int((center[np.minimum(spot, len(center) - 1)] == t).sum())
                if 100 * common >= percent * (len(t) + len(center) - common) and digest(t) == (lo, hi):
                    a.append(key)
                    b.append(pivot)
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def merge(label: np.ndarray, q: int, members: np.ndarray) -> None:
    """Give everything that has the label of ``q`` or of one of ``members`` the smallest of these labels."""
    old = np.unique(np.append(label[members], label[q]))
    label[np.isin(label, old)] = old[0]


def askers(label: np.ndarray) -> np.ndarray:
    """All but the members of the most frequent label, which are linked already: each pair that isn't has one of these."""
    values, code, count = np.unique(label, return_inverse=True, return_counts=True)
    return np.flatnonzero(code != count.argmax())


class Parities:
    """Parity bits of sets of one class, and of those below that can link, at the width of the smallest.

    Each bit that differs needs a token that only one of two sets has, so their overlap is at most (n + n' - differing bits) / 2.
    """

    def __init__(self, raw: list[bytes], n: np.ndarray):
        width = min(map(len, raw))
        self.n = n
        rows = [np.frombuffer(x, np.uint8).reshape(-1, width) for x in raw]
        self.bits = np.stack([r[0] if len(r) == 1 else np.bitwise_xor.reduce(r, axis=0) for r in rows]).view(np.uint64)

    def bound(self, a: np.ndarray, q: int) -> np.ndarray:
        return (self.n[a] + self.n[q] - np.bitwise_count(self.bits[a] ^ self.bits[q]).sum(1, dtype=np.int64)) // 2

    def may_link(self, a: np.ndarray, q: int, percent: int) -> np.ndarray:
        """Whether the sets ``a`` can overlap with the set ``q`` by ``percent``."""
        return self.bound(a, q) * (100 + percent) >= percent * (self.n[a] + self.n[q])


def _bounded(percent: int):
    """Spanning forests, by bin, of the pairs of labels whose overlap can reach ``percent`` by their parity bits."""

    def forest(n: np.ndarray, raw: list[bytes], names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(n, kind="stable")
        n, names = n[order], names[order]
        sets = Parities([raw[i] for i in order], n)
        values, label = np.unique(names, return_inverse=True)
        first = label.copy()
        low, high = np.searchsorted(n * 100, n * percent), np.searchsorted(n * percent, n * 100, "right")  # sizes that can link
        for q in askers(label):
            member = np.arange(low[q], high[q])
            member = member[label[member] != label[q]]
            if len(member):
                member = member[sets.may_link(member, q, percent)]
            if len(member):
                merge(label, q, member)
        pairs = np.unique(np.stack([first, label], 1), axis=0)
        pairs = pairs[pairs[:, 0] != pairs[:, 1]]
        return values[pairs[:, 0]], values[pairs[:, 1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(whole: bool) -> Iterator[pa.RecordBatch]:
            """Bins that have ended; the last one may go on in the next batch."""
            nonlocal held
            t = pa.Table.from_batches(held).combine_chunks()
            key = t["bin"].to_numpy()
            ends = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [len(key)]])
            last = int(ends[-1 if whole else -2])
            ends = ends[: len(ends) - (not whole)]
            held = t.slice(last).to_batches()
            n, names, raw = t["n"].to_numpy(), t["label"].to_numpy(), t["bits"].slice(0, last).to_pylist()
            out = [(np.zeros(0, np.int64),) * 2]
            for a, z in zip(ends, ends[1:], strict=False):
                if z - a > 2:
                    out.append(forest(n[a:z], raw[a:z], names[a:z]))
                elif z - a == 2 and names[a] != names[a + 1] and Parities(raw[a:z], n[a:z]).may_link(np.array([0]), 1, percent)[0]:
                    out.append((names[a : a + 1], names[a + 1 : z]))
            a, b = (np.concatenate(x) for x in zip(*out, strict=True))
            if len(a):
                yield pa.record_batch([pa.array(a), pa.array(b)], names=["a", "b"])

        for b in batches:
            if b.num_rows:
                held.append(b)
                if sum(x.num_rows for x in held) >= BLOCK:
                    yield from flush(False)
        if held:
            yield from flush(True)

    return run


class TokenGroupMatrix:
    """Exact join of one cell's sets.  ``labels`` gives connected sets one number."""

    GROUP = 32

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.percent, self.sizes = percent, np.array([len(s) for s in sets], np.int64)
        every = np.concatenate([np.zeros(0, np.uint64), *sets])
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        names, local, count = np.unique(every, return_inverse=True, return_counts=True)
        shared = count[local] > 1  # a token of one set alone can't be in an intersection
        renamed = np.cumsum(count > 1) - 1
        tokens, owner = renamed[local[shared]], owner[shared]
        self.n_tokens = int((count > 1).sum())
        self.off = np.searchsorted(owner, np.arange(len(sets) + 1))
        df = np.bincount(tokens, minlength=self.n_tokens)
        # Similar sets stand together: order by the most frequent token, then the next ones by a hash.
        key = np.full((len(sets), 2), -1, np.int64)
        for k in range(len(sets)):
            t = tokens[self.off[k] : self.off[k + 1]]
            if len(t):
                top = t[np.argpartition(-df[t], min(1, len(t) - 1))[:2]]
                key[k, : len(top)] = np.sort(top)
        order = np.lexsort((self.sizes, key[:, 1], key[:, 0]))
        self.order = order
        self.sets = [tokens[self.off[k] : self.off[k + 1]] for k in order]
        self.sizes = self.sizes[order]
        self.ends = np.cumsum([0, *map(len, self.sets)])
        self.flat = np.concatenate([np.zeros(0, np.int64), *self.sets])
        group = np.repeat(np.arange(len(sets)) // self.GROUP, np.diff(self.ends))
        n_groups = -(-len(sets) // self.GROUP)
        union = np.unique(self.flat * max(n_groups, 1) + group)  # the matrix: tokens by groups, as sorted pairs
        self.row_groups = union % max(n_groups, 1)
        self.row_off = np.searchsorted(union // max(n_groups, 1), np.arange(self.n_tokens + 1))
        self.n_groups = n_groups
        self.least = np.array([self.sizes[g * self.GROUP : (g + 1) * self.GROUP].min() for g in range(n_groups)])
        self.most = np.array([self.sizes[g * self.GROUP : (g + 1) * self.GROUP].max() for g in range(n_groups)])

    def labels(self, given: np.ndarray) -> np.ndarray:
        """``given`` labels of the sets, in their order, merged where a pair of sets links."""
        n = len(self.sets)
        label = np.asarray(given)[self.order]
        flag = np.zeros(self.n_tokens + 1, np.int64)
        for q in askers(label):
            t = self.sets[q]
            need = -(-self.percent * int(self.sizes[q]) // 100)
            if len(t) < need or not len(t):
                continue
            lo, hi = self.row_off[t], self.row_off[t + 1]
            size = hi - lo
            at = np.repeat(lo - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
            bound = np.bincount(self.row_groups[at], minlength=self.n_groups)
            least = -(-self.percent * self.least // 100)
            opened = np.flatnonzero((bound >= need) & (bound >= least) & (self.most * 100 >= self.sizes[q] * self.percent) & (self.least * self.percent <= self.sizes[q] * 100))
            member = (opened[:, None] * self.GROUP + np.arange(self.GROUP)).ravel()
            member = member[member < n]
            member = member[label[member] != label[q]]
            if not len(member):
                continue
            flag[t] = 1
            length = self.ends[member + 1] - self.ends[member]
            start = np.concatenate([[0], np.cumsum(length)])
            both = flag[self.flat[np.repeat(self.ends[member] - start[:-1], length) + np.arange(start[-1])]]
            total = np.concatenate([[0], np.cumsum(both)])
            common = total[start[1:]] - total[start[:-1]]
            flag[t] = 0
            linked = member[100 * common >= self.percent * (self.sizes[q] + self.sizes[member] - common)]
            if len(linked):
                merge(label, q, linked)
        out = np.empty(n, label.dtype)
        out[self.order] = label
        return out


def connected(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root): the smallest node reachable, for nodes of ``edges`` (a, b).

    Alternating large-star and small-star rounds, each written to the shared folder; logarithmic in the longest path.
    """
    now = scratch.stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), "edges")
    while True:
        # A forest of stars has no node on both sides, and no node with two roots.
        if now.join(now.select(F.col("b").alias("a")).distinct(), "a", "left_semi").isEmpty() and now.groupBy("a").count().where("count > 1").isEmpty():
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        small = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(small, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = large.unionByName(now.join(small, "a").select("a", F.col("m").alias("b"))).where("a != b").distinct()
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        star = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        now = scratch.stored(star.where("a != b").distinct(), "edges")


def _bins(rows: DataFrame, root: str, docs: int, tokens: int) -> DataFrame:
    """``rows`` (``root``, key, label, n) dealt out to bins, so that each pair of one root with two labels meets in one of them.

    A bin has about 2 * ``docs`` rows and sets of 2 * ``tokens`` tokens at most.  Parts of the label with most rows meet those of the rest,
    and these meet one another.
    """
    by = rows.groupBy(root, "label").agg(F.count("*").alias("c"), F.sum("n").alias("t")).groupBy(root).agg(F.max(F.struct("c", "t", "label")).alias("top"), F.sum("c").alias("c"), F.sum("t").alias("t"))

    def parts(c: F.Column, t: F.Column) -> F.Column:
        return F.greatest(F.ceil(c / docs), F.ceil(t / tokens), F.lit(1)).cast("int")

    plan = by.select(root, F.col("top.label").alias("top"), parts(F.col("top.c"), F.col("top.t")).alias("tops"), parts(F.col("c") - F.col("top.c"), F.col("t") - F.col("top.t")).alias("rests"))
    at = rows.join(plan, root)
    mine = F.pmod(F.xxhash64("key"), F.when(F.col("label") == F.col("top"), F.col("tops")).otherwise(F.col("rests"))).cast("int")
    at = at.withColumn("own", mine)
    with_top = F.transform(F.sequence(F.lit(0), F.col("tops") - 1), lambda k: F.xxhash64(F.lit(1), root, F.col("own"), k))
    with_rest = F.transform(F.sequence(F.lit(0), F.col("rests") - 1), lambda k: F.xxhash64(F.lit(2), root, F.least("own", k), F.greatest("own", k)))
    of_top = F.transform(F.sequence(F.lit(0), F.col("rests") - 1), lambda k: F.xxhash64(F.lit(1), root, k, F.col("own")))
    bins = F.when(F.col("label") == F.col("top"), of_top).when(F.col("rests") > 1, F.concat(with_top, with_rest)).otherwise(with_top)
    return at.select("key", "label", "n", F.explode(bins).alias("bin"))


def _texts(places: DataFrame, reps: DataFrame, rows: DataFrame) -> DataFrame:
    """Whole texts for ``places`` (bin, label, key), sorted by bin and label.  Texts that no bin needs stay where they are.

    A text is found by its id and hash, as other texts may have the same id.
    """
    wanted = places.join(reps.select("key", "rep.doc_id", "rep.text_hash", "lo", "hi"), "key")
    return rows.join(wanted, ["doc_id", "text_hash"]).select("bin", "label", "key", "lo", "hi", "text").repartition("bin").sortWithinPartitions("bin", "label", "key")


def _open(n: int, percent: int):
    """Links between the labels in each cell, by the token-group matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: list[int] = []
        keys: set[int] = set()
        sets: list[np.ndarray] = []

        def links() -> pa.RecordBatch:
            given = np.array(names, np.int64)
            label = TokenGroupMatrix(sets, percent).labels(given) if len(set(names)) > 1 else given
            out = np.flatnonzero(label != given)
            return pa.record_batch([pa.array(given[out]), pa.array(label[out])], names=["a", "b"])

        last = None
        for s in slices(batches, most=SLICE):
            tokens, off = shingle_sets(s.column("text"), n)
            for k, (cell, label, key, lo, hi) in enumerate(zip(*(s.column(c).to_pylist() for c in ("bin", "label", "key", "lo", "hi")), strict=True)):
                if cell != last and sets:
                    yield links()
                    names, keys, sets = [], set(), []
                last = cell
                t = tokens[off[k] : off[k + 1]]
                if key not in keys and digest(t) == (lo, hi):
                    names.append(label)
                    keys.add(key)
                    sets.append(t.copy())
        yield links()

    return run


def ngram_join(docs: DataFrame, n: int = 5, percent: int = 80, group_docs: int = 2048, group_tokens: int = 500_000, block_docs: int = 4096, block_tokens: int = 4_000_000) -> DataFrame:
    """Components of documents linked at Jaccard similarity of ``percent`` or more over word ``n``-grams.

    Per row: doc_id, text_hash, n_shingles, component_id (smallest doc_id reachable), class_key (a component's number, null without
    shingles or id; it tells two components apart whose smallest id is the same).  Null, empty and blank texts have no shingles
    and are alone.  Rows with equal ids are rows of their own: each has the component of its own text.  Rows without an id
    are left out of linking: their component is null.  Texts of any length are one set; an empty table gives an empty result.
    Further columns are ignored, whatever their names.  ``group_docs``, ``group_tokens``, ``block_docs`` and
    ``block_tokens`` bound the memory of a cell and a block; larger ones are split, and parts with different labels meet, so they drop nothing.
    A cell always holds whole sets, so a text of more than ``group_tokens`` n-grams needs the memory of its own set.
    The result is stored; what was stored on the way is deleted.
    """
    rows = id_text(docs, hashed=True)
    with Scratch(docs.sparkSession) as scratch:
        sig = scratch.stored(signatures(rows, n, percent, frequency_levels(rows, n)), "signatures")
        kept = [F.first(c, ignorenulls=True).alias(c) for c in ("mins", "cut", "prefix", "bits")]
        reps = sig.where("n > 0 AND doc_id IS NOT NULL").groupBy("lo", "hi", "n").agg(F.min(F.struct("doc_id", "text_hash")).alias("rep"), *kept)
        reps = scratch.stored(reps.withColumn("key", F.monotonically_increasing_id()), "reps")
        scratch.clean()

        # Members of a min-hash group against its pivot, in bins of bounded size.
        mins = reps.select("key", F.posexplode("mins").alias("j", "least"))
        pivots = mins.groupBy("j", "least").agg(F.min("key").alias("pivot"), F.count("*").alias("size")).where("size > 1")
        pairs = scratch.stored(mins.join(pivots, ["j", "least"]).where("key != pivot").select("key", "pivot").distinct(), "pairs")
        spread = pairs.groupBy("pivot").agg(F.ceil(F.count("*") / group_docs).alias("bins"))
        spot = F.xxhash64("pivot", F.pmod(F.xxhash64("key"), F.col("bins")))
        members = pairs.join(spread, "pivot").select(spot.alias("bin"), "key", F.lit(1).alias("label"))
        centers = spread.select("pivot", "bins", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bins") - 1)).alias("k")).select(F.xxhash64("pivot", "k").alias("bin"), F.col("pivot").alias("key"), F.lit(0).alias("label"))
        links = scratch.stored(_texts(members.unionByName(centers), reps, rows).mapInArrow(tidied(_against_pivot(n, percent)), "a long, b long"), "links")
        labels = scratch.stored(connected(links, scratch), "labels")
        scratch.drop("edges", "pairs", "links")

        # Prefix tokens that sets with different labels hold.  Only frequent tokens can have many holders: these are counted first.
        rare = reps.select("key", F.explode(F.expr("slice(prefix, 1, cut)")).alias("token"))
        rare = rare.withColumn("size", F.count("*").over(W.partitionBy("token"))).where("size > 1").select("key", "token")
        often = reps.where("cut < size(prefix)").select("key", F.explode(F.expr("slice(prefix, cut + 1, size(prefix))")).alias("token"))
        often = often.join(often.groupBy("token").agg(F.count("*").alias("size")).where("size > 1").select("token"), "token").select("key", "token")
        held = scratch.stored(rare.unionByName(often), "held")
        scratch.clean()
        held = held.join(labels.select(F.col("node").alias("key"), "root"), "key", "left").select("token", "key", F.coalesce("root", "key").alias("label"))
        held = scratch.stored(held, "labelled")
        scratch.drop("held")
        holders = [F.count("*").alias("size"), *(F.bit_xor(F.xxhash64("key", F.lit(k))).alias(f"x{k}") for k in (1, 2))]
        mixed = held.groupBy("token").agg(F.min("label").alias("least"), F.max("label").alias("most"), *holders).where("least != most")
        mixed = mixed.groupBy("size", "x1", "x2").agg(F.min("token").alias("token")).select("token")
        open_ = scratch.stored(held.join(mixed, "token"), "open")
        scratch.drop("labelled")

        # Labels that the bits can't keep apart form groups of similar documents, which no link leaves.
        # Sets that link differ little in size: a set meets those of its class, and of the classes that its partners can have.
        own, above = (F.greatest(F.length(F.bin(x)) - 1, F.lit(6)) for x in (F.col("n"), F.floor(F.col("n") * 100 / percent)))
        sized = open_.join(reps.select("key", "n"), "key").withColumn("root", F.explode(F.transform(F.sequence(own, above), lambda c: F.xxhash64("token", c))))
        lone = sized.groupBy("root").agg(F.min("label").alias("least"), F.max("label").alias("most")).where("least != most").select("root")
        blocks = _bins(scratch.stored(sized.join(lone, "root").select("root", "key", "label", "n"), "sized"), "root", block_docs, block_tokens).select("key", "label", "bin")
        blocks = blocks.join(reps.select("key", "n", "bits"), "key").select("bin", "label", "n", "bits")
        maybe = blocks.repartition("bin").sortWithinPartitions("bin").mapInArrow(tidied(_bounded(percent)), "a long, b long")
        groups = scratch.stored(connected(maybe, scratch), "groups")
        scratch.drop("edges")
        groups = groups.unionByName(groups.select(F.col("root").alias("node"), "root")).distinct()
        inside = open_.select("key", "label").distinct().join(groups.withColumnRenamed("node", "label"), "label").join(reps.select("key", "n"), "key")
        cells = _bins(scratch.stored(inside, "inside"), "root", group_docs, group_tokens).select("bin", "label", "key")
        found = scratch.stored(_texts(cells, reps, rows).mapInArrow(tidied(_open(n, percent)), "a long, b long"), "found")
        scratch.drop("open", "sized", "inside", "groups")
        joined = scratch.stored(connected(found, scratch), "joined")

        # Representatives have the label of their pivot, labels that of the cells; the smallest id of a final label names it.
        final = reps.select("key", "lo", "hi", "n", F.col("rep.doc_id").alias("rep")).join(labels.select(F.col("node").alias("key"), "root"), "key", "left").withColumn("label", F.coalesce("root", "key")).drop("root")
        final = final.join(joined.select(F.col("node").alias("label"), "root"), "label", "left").withColumn("label", F.coalesce("root", "label"))
        named = final.groupBy("label").agg(F.min("rep").alias("component_id"))
        final = final.join(named, "label").select("lo", "hi", "n", "component_id", F.col("label").alias("class_key"))
        out = sig.select("doc_id", "text_hash", "n", "lo", "hi").join(final, ["lo", "hi", "n"], "left")
        known = F.col("doc_id").isNotNull()
        return stored(out.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), F.when(known, F.coalesce("component_id", "doc_id")).alias("component_id"), F.when(known, F.col("class_key")).alias("class_key")), "ngram-join")


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(read(spark, sf_dir, "documents"), n=3, percent=90).select("doc_id", "n_shingles", "component_id")


QUERIES = {"op8_ngram_join": op8_ngram_join}
SQL: dict[str, str] = {}
