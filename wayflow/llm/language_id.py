"""Language identification: multinomial naive Bayes over hashed character n-grams.

One pass counts hashed n-grams for each language over all training rows; the log-probability matrix (languages times
2**16 buckets) is broadcast, and a second pass scores every text with numpy.  A matrix of more than ``most`` languages goes in parts of
that many, 256 KB a language, each with a pass of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, added, read, segment_sums, slices, stored, task, tidied

BITS, BLOCK, SPACE = 16, 1 << 12, 32
#: Languages whose counts a counting task holds at once.
HELD = 64


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def ngrams(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """For n of 1, 2 and 3: bucket of the n-gram that ends at each character, 0 where there is none; text offsets; letters.

    Text is lower-cased, and every character but a letter counts as a space.  An n-gram has a letter in its middle
    (n of 3), at any place (2) or is one (1).
    """
    joined = "\0".join(x.replace("\0", " ") for x in texts) + "\0"
    code = np.frombuffer(joined.lower().encode("utf-32-le", "replace"), np.uint32)
    off = np.concatenate([[0], np.flatnonzero(code == 0) + 1])
    letter = _letters()[code]
    c = np.where(letter, code, np.uint32(SPACE))
    b = np.concatenate([[np.uint32(SPACE)], c[:-1]])
    a = np.concatenate([np.full(min(2, len(c)), SPACE, np.uint32), c[:-2]])[: len(c)]
    lb = np.concatenate([[False], letter[:-1]])
    mul, shift = np.uint32(0x9E3779B1), np.uint32(32 - BITS)
    one = c * mul
    two = (b * np.uint32(0x85EBCA6B) ^ one) * mul
    three = (a * np.uint32(0xC2B2AE35) ^ two) * mul
    keep = [letter, letter | lb, lb]
    return [np.where(k, (x >> shift) | np.uint32(1), np.uint32(0)) for k, x in zip(keep, (one, two, three), strict=True)], off, letter


def _count(batches: Iterator[pa.RecordBatch], held: int) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    part, sent = task(), 0

    def send() -> Iterator[pa.RecordBatch]:
        nonlocal sent
        number = part + (sent % 1024 << 20)  # a further load of one task is summed as if it were another's
        for lang, total in counts.items():
            blocks = total.reshape(-1, BLOCK)
            n = len(blocks)
            yield pa.record_batch([pa.array([lang] * n), pa.array(range(n), pa.int32()), pa.array([number] * n, pa.int32()), pa.array([x.tobytes() for x in blocks], pa.binary())], names=["lang", "block", "part", "counts"])
        counts.clear()
        sent += 1

    for rows in slices(batches):
        langs = np.array(rows.column("lang").to_pylist(), object)
        texts = rows.column("text").to_pylist()
        for lang in sorted(set(langs)):
            grams, _, _ = ngrams([texts[i] for i in np.flatnonzero(langs == lang)])
            if lang not in counts and len(counts) >= held:
                yield from send()
            total = counts.setdefault(lang, np.zeros(1 << BITS, np.int64))
            for g in grams:
                total += np.bincount(g, minlength=1 << BITS)
    yield from send()


class Model:
    """Languages in order, their log priors, and their log-probability matrix in parts, each made when it is asked for."""

    def __init__(self, prior: dict[str, int], counts: DataFrame, alpha: float, most: int):
        langs = sorted(prior)
        self.parts = [langs[k : k + most] for k in range(0, len(langs), most)]
        self.prior, self.counts, self.alpha, self.n = prior, stored(counts, "language-counts") if len(self.parts) > 1 else counts, alpha, sum(prior.values())

    def part(self, k: int) -> tuple[list[str], np.ndarray]:
        """The languages of part ``k`` and their matrix, whose column 0, where no n-gram falls, has the log priors."""
        langs = self.parts[k]
        at = {lang: i for i, lang in enumerate(langs)}
        counts = np.zeros((len(langs), 1 << BITS))
        for r in (self.counts if len(self.parts) == 1 else self.counts.where(F.col("lang").isin(langs))).collect():
            counts[at[r.lang], r.block * BLOCK : (r.block + 1) * BLOCK] = np.frombuffer(r.counts, np.int64)
        counts[:, 0] = 0
        matrix = np.log(counts + self.alpha) - np.log(counts.sum(1, keepdims=True) + self.alpha * counts.shape[1])
        matrix[:, 0] = [np.log(self.prior[lang] / self.n) for lang in langs]
        return langs, matrix.astype(np.float32)


def train(docs: DataFrame, alpha: float = 0.5, most: int = 128, held: int = HELD) -> Model:
    """A model of all languages of ``docs`` (text and lang), in parts of at most ``most`` languages, whatever their number.

    Rows without a language are left out, a null text counts as empty.  No rows: no languages.  A
    counting task holds the counts of ``held`` languages at once, 512 KB each.
    """
    rows = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.col("lang").cast("string").alias("lang")).where("lang IS NOT NULL")
    prior = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}  # a row for each language
    return Model(prior, added(rows.mapInArrow(tidied(partial(_count, held=held)), "lang string, block int, part int, counts binary"), ["lang", "block"]), alpha, most)


def _scored(rows: DataFrame, langs: list[str], matrix: np.ndarray, last: bool) -> DataFrame:
    """``rows`` (doc_id, text, lang_pred, top, total) after these languages too; without the text if they are the ``last``."""
    shared = rows.sparkSession.sparkContext.broadcast((langs, matrix))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, logs = shared.value
        prior, table = logs[:, 0].astype(np.float64), logs.copy()
        table[:, 0] = 0
        names = np.array(names, object)
        for b in slices(batches):
            grams, off, letter = ngrams(b.column("text").to_pylist())
            some = segment_sums(letter.astype(np.int8), off) > 0
            points = np.zeros((len(off) - 1, len(prior)))
            for k in range(len(prior)):
                points[:, k] = prior[k] + segment_sums(sum(table[k][g] for g in grams), off)
            before, total = (b.column(c).to_numpy(zero_copy_only=False) for c in ("top", "total"))
            here = points.max(1)
            top = np.maximum(before, here)
            total = total * np.exp(before - top) + np.exp(points - top[:, None]).sum(1)
            # Of equal languages the first in order wins.
            pred = np.where(here > before, names[points.argmax(1)], np.array(b.column("lang_pred").to_pylist(), object))
            pred[~some], top[~some] = "und", -np.inf
            out = {"doc_id": b.column("doc_id"), "text": b.column("text"), "lang_pred": pa.array(pred.tolist(), pa.string()), "top": pa.array(top), "total": pa.array(total)}
            if last:
                out.pop("text")
            yield pa.RecordBatch.from_pydict(out)

    return rows.mapInArrow(tidied(run), f"doc_id long, {'' if last else 'text string, '}lang_pred string, top double, total double")


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score (posterior probability).  ``und`` with score 0 for no letter, or if nothing was learned.

    Each row is decided for itself, whatever others have its id; very long texts are taken whole, other columns left out,
    and an empty table gives an empty one.  With several parts, rows are stored in the shared folder between the passes.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text, F.lit("und").alias("lang_pred"), F.lit(float("-inf")).alias("top"), F.lit(0.0).alias("total"))
    scratch, n = Scratch(docs.sparkSession), len(model.parts)
    for k in range(n):
        if k:
            rows = scratch.stored(rows, "language-scores")
            scratch.drop("language-scores", keep=1)
        rows = _scored(rows, *model.part(k), k == n - 1)
    return rows.select("doc_id", "lang_pred", F.when(F.col("top") == float("-inf"), 0.0).otherwise(1 / F.col("total")).alias("score"))


def remainder(doc_id: str, mod: int) -> F.Column:
    """crc32 of the id as text modulo ``mod``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(mod))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    out = predict(docs, train(docs.where(remainder("doc_id", 4) != 2)))
    return out.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


QUERIES = {"op10_language_id": op10_language_id}
SQL: dict[str, str] = {}
