"""Quality classifier: a linear-chain conditional random field over the lines of a document.

Every line is good or bad.  Its features are those of the line and of its neighbours; the chain is trained by maximum
likelihood with each line carrying its document's label.  Forward-backward gives each line's marginal, the mean of the
marginals weighted by length is the document's, and a logistic curve fitted on the training documents turns that into
a probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import buffers, id_text, read, segment_sums, slices, spaced, tidied, word_hashes
from .language_id import remainder

# Byte classes: other, letter or non-ASCII, upper case, digit, white space, sentence punctuation, symbol.
OTHER, LETTER, UPPER, DIGIT, WHITE, STOP, SYMBOL, CLASSES = range(8)
_CLASS = np.full(256, OTHER, np.int64)
for _c in range(33, 127):
    _CLASS[_c] = SYMBOL
for _c in range(128, 256):
    _CLASS[_c] = LETTER
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = LETTER, UPPER, DIGIT
_CLASS[[9, 10, 11, 12, 13, 32]] = WHITE
_CLASS[list(b".,;:?'\"-()")] = STOP
BASE = 20
#: Bytes of text whose line features are in memory at once, as some 50 times as much.
SLICE = 1 << 20


def line_features(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of each line (lines, 3 * BASE + 1), its weight (bytes) and n + 1 line offsets of the texts.

    Lines end at a line feed; the last one may be empty.  The features of the line before and after follow the line's
    own, as zeros at the ends of a text.
    """
    data, off = spaced(*buffers(text))
    breaks = (data == 10).astype(bool)
    breaks[off[1:] - 1] = True  # the added space ends the last line of each text
    ends = np.flatnonzero(breaks) + 1
    lo = np.concatenate([[0], ends])
    lines = len(ends)
    lines_off = np.searchsorted(ends, off, "right")
    line_of = np.repeat(np.arange(lines), np.diff(lo))
    n = np.maximum(np.diff(lo) - 1, 0).astype(np.float64)
    count = np.bincount(line_of * CLASSES + _CLASS[data], minlength=lines * CLASSES).reshape(lines, CLASSES).astype(np.float64)
    size = np.maximum(n, 1)
    start, end, h = word_hashes(data)
    word_line = line_of[start]
    words = np.maximum(np.bincount(word_line, minlength=lines), 1).astype(np.float64)

    def share(mask: np.ndarray) -> np.ndarray:
        return np.bincount(word_line, weights=mask, minlength=lines) / words

    def before(k: int) -> np.ndarray:
        same = np.zeros(len(h), bool)
        same[k:] = (h[k:] == h[:-k]) & (word_line[k:] == word_line[:-k])
        return same

    last = _CLASS[data[end - 1]] if len(end) else np.zeros(0, np.int64)
    ends_odd = np.zeros(len(h), bool)
    if len(h):
        second = _CLASS[data[np.maximum(end - 2, start)]]
        ends_odd = (last == SYMBOL) & (second == SYMBOL)
    alone = (end - start == 1) & (last == SYMBOL)
    whole = np.add.reduceat(np.concatenate([h * np.uint64(3), [np.uint64(0)]]), np.minimum(np.searchsorted(word_line, np.arange(lines)), len(h))) if lines else np.zeros(0, np.uint64)
    again = np.zeros(lines, bool)
    again[1:] = (whole[1:] == whole[:-1]) & (n[1:] > 0)
    letters = np.maximum(count[:, LETTER] + count[:, UPPER], 1)
    symbol = count[:, SYMBOL] / size
    repeat = share(before(1) | before(2))
    own = np.stack(
        [count[:, LETTER] / size, count[:, UPPER] / letters, count[:, DIGIT] / size, (count[:, WHITE] - 1) / size, count[:, STOP] / size, symbol, np.minimum(symbol * 8, 1), share(ends_odd), share(ends_odd) > 0.3,
         share(alone), share(alone) > 0.15, repeat, repeat > 0.3, count[:, UPPER] / letters > 0.5, again, np.log1p(n) / 10, n < 20, n == 0, np.minimum(n / words / 12, 2), count[:, OTHER] / size],
        1,
    ).astype(np.float32) if lines else np.zeros((0, BASE), np.float32)
    prev, nxt = np.zeros_like(own), np.zeros_like(own)
    prev[1:], nxt[:-1] = own[:-1], own[1:]
    prev[lines_off[:-1]], nxt[lines_off[1:] - 1] = 0, 0
    return np.concatenate([own, prev, nxt, np.ones((lines, 1), np.float32)], 1), n, lines_off


def forward_backward(emit: np.ndarray, link: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Marginal of good for each line, summed pair marginals (2, 2), and the log partition summed over documents.

    ``emit`` has log potentials of bad and good, ``link`` those of transitions.  All documents advance together: step t
    handles line t of those that are long enough, longest first.
    """
    size = np.diff(off)
    order = np.argsort(-size, kind="stable")
    first, size = off[:-1][order], size[order]
    steps = int(size[0]) if len(size) else 0
    active = [int(np.searchsorted(-size, -t, "left")) for t in range(steps)]  # documents with more than t lines
    alpha, beta = emit.copy(), np.zeros_like(emit)
    norm = 0.0
    pairs = np.zeros((2, 2))
    for t in range(1, steps):
        at = first[: active[t]] + t
        alpha[at] += np.logaddexp(alpha[at - 1, :1] + link[0], alpha[at - 1, 1:] + link[1])
    for t in range(steps - 1, 0, -1):
        at = first[: active[t]] + t
        x = emit[at] + beta[at]
        beta[at - 1] = np.logaddexp(link[:, 0] + x[:, :1], link[:, 1] + x[:, 1:])
    full = alpha + beta
    z = np.logaddexp(full[:, 0], full[:, 1])
    for t in range(1, steps):
        at = first[: active[t]] + t
        p = np.exp(alpha[at - 1][:, :, None] + link + (emit[at] + beta[at])[:, None, :] - z[at][:, None, None])
        pairs += p.sum(0)
    has = np.diff(off) > 0
    norm = float(z[off[:-1][has]].sum())
    return np.exp(full[:, 1] - z), pairs, norm


@dataclass
class Model:
    """Weights of good against bad, transitions, feature centre and scale, logistic curve, and the share of good documents."""

    weights: np.ndarray
    link: np.ndarray
    curve: tuple[float, float]
    prior: float

    def raw(self, features: np.ndarray, n: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Mean marginal by length; NaN for a text without characters."""
        emit = np.zeros((len(features), 2))
        emit[:, 1] = features @ self.weights
        good, _, _ = forward_backward(emit, self.link, off)
        with np.errstate(invalid="ignore"):
            return segment_sums(good * n, off) / segment_sums(n, off)

    def score(self, features: np.ndarray, n: np.ndarray, off: np.ndarray) -> np.ndarray:
        raw = self.raw(features, n, off)
        return np.where(np.isnan(raw), self.prior, 1 / (1 + np.exp(-(self.curve[0] * raw + self.curve[1]))))


def fit(features: np.ndarray, n: np.ndarray, off: np.ndarray, label: np.ndarray, rounds: int = 150, decay: float = 1e-3) -> Model:
    """Maximum likelihood by Adam.  No documents: every score is 0.5; one label only: every score is that label's share."""
    docs = len(label)
    prior = float(label.mean()) if docs else 0.5
    if not docs or prior in (0.0, 1.0):
        return Model(np.zeros(features.shape[1]), np.zeros((2, 2)), (0.0, 0.0 if not docs else 50.0 * (prior * 2 - 1)), prior)
    y = np.repeat(label, np.diff(off)).astype(np.float64)
    scale = len(y)
    theta = np.zeros(features.shape[1] + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    inside = np.ones(len(y), bool)
    inside[off[:-1]] = False
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[np.flatnonzero(inside) - 1].astype(int), y[inside].astype(int)), 1)
    for k in range(1, rounds + 1):
        emit = np.zeros((len(y), 2))
        emit[:, 1] = features @ theta[:-4]
        good, pairs, _ = forward_backward(emit, theta[-4:].reshape(2, 2), off)
        grad = np.concatenate([features.T @ (y - good), (seen - pairs).ravel()]) / scale - decay * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta += 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    model = Model(theta[:-4], theta[-4:].reshape(2, 2), (1.0, 0.0), prior)
    raw = model.raw(features, n, off)
    some = ~np.isnan(raw)
    x = np.stack([raw[some], np.ones(some.sum())], 1)
    t = label[some].astype(np.float64)
    ab = np.zeros(2)
    for _ in range(50):  # Newton with a small ridge
        p = 1 / (1 + np.exp(-x @ ab))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2), x.T @ (t - p) - 1e-2 * ab)
        ab = ab + np.clip(step, -5, 5)
    model.curve = (float(ab[0]), float(ab[1]))
    return model


def train(docs: DataFrame, labels: DataFrame, max_docs: int = 6000) -> Model:
    """Fit on at most ``max_docs`` labelled documents, those with the smallest hash of their id; labels that are null are left out."""
    some = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id IS NOT NULL AND quality IS NOT NULL")
    some = some.groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)
    rows = id_text(docs).join(F.broadcast(some), "doc_id").select("doc_id", "text", "quality")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, most=SLICE):
            x, n, off = line_features(b.column("text"))
            ids, label = b.column("doc_id").to_pylist(), b.column("quality").to_pylist()
            cut = [(x[a:z], n[a:z]) for a, z in zip(off, off[1:], strict=False)]
            yield pa.record_batch([pa.array(ids), pa.array(label, pa.int32()), pa.array([c[0].tobytes() for c in cut], pa.binary()), pa.array([c[1].tobytes() for c in cut], pa.binary())], names=["doc_id", "quality", "x", "n"])

    got = sorted(rows.mapInArrow(tidied(run), "doc_id long, quality int, x binary, n binary").collect(), key=lambda r: (r.doc_id, r.x))
    width = 3 * BASE + 1
    x = [np.frombuffer(r.x, np.float32).reshape(-1, width) for r in got]
    off = np.cumsum([0, *map(len, x)])
    n = np.concatenate([np.zeros(0), *(np.frombuffer(r.n, np.float64) for r in got)])
    return fit(np.concatenate([np.zeros((0, width), np.float32), *x]).astype(np.float64), n, off, np.array([r.quality for r in got], np.int64))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score for every row; empty and null texts get the share of good training documents."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, most=SLICE):
            yield pa.record_batch([b.column("doc_id"), pa.array(shared.value.score(*line_features(b.column("text"))).astype(np.float64))], names=["doc_id", "score"])

    return id_text(docs).mapInArrow(tidied(run), "doc_id long, score double")


def keep(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs``, with all their columns, that score ``threshold`` or more: a filter in the scan."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = next(i for i, c in enumerate(docs.columns) if c.lower() == "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = pa.RecordBatch.from_arrays(b.columns, names=[f"c{i}" for i in range(b.num_columns)])
            for part in slices([b], f"c{at}", SLICE):
                good = shared.value.score(*line_features(part.column(at))) >= threshold
                yield pa.RecordBatch.from_arrays(part.filter(pa.array(good)).columns, names=docs_names)

    docs_names = docs.columns
    return docs.mapInArrow(tidied(run), docs.schema)


THRESHOLD = 0.3


def op4_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    model = train(docs, labels.where(remainder("doc_id", 5) != 0))
    return score(docs, model).select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op4_quality_crf": op4_quality_crf}
SQL: dict[str, str] = {}
