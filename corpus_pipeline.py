"""Corpus pipeline: quality, exact dedup, near duplicates, mixing, packing.

Each stage takes all that its predecessor kept, and all but the last return the columns of ``docs``, as they came.  In every stage
null and empty texts are documents like others, rows without an id too; an empty table gives an empty one; very long
texts are taken whole; columns beyond those of documents stay, whatever their names.  Rows with one id and different texts are decided
each for itself.  Of rows that are alike in id and text, dedup and near duplicates leave one, and mixing as many as it takes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from wayflow.llm import exact_dedup, mixing, ngram_join, packing, quality_crf
from wayflow.llm.common import read, shared_path
from wayflow.llm.language_id import remainder

FRACTION = 0.9


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject; it learns from labelled documents outside the held-out fifth."""
    model = quality_crf.train(docs, read(spark, sf_dir, "labels").where(remainder("doc_id", 5) != 0))
    return quality_crf.keep(docs, model, quality_crf.THRESHOLD)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row of each group of equal texts that stays: most code points, then the smallest id."""
    found = exact_dedup.exact_dedup(docs).where("kept")
    return _rows(docs, found.groupBy("text_sha256").agg(F.max_by(F.struct("doc_id", "text_hash"), F.struct("n_chars", "text_hash")).alias("row")))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each group of near duplicates: five words, similarity 0.8.  Documents without words, and rows without an id, all stay."""
    found = ngram_join.ngram_join(docs, n=5, percent=80)
    row = F.struct("doc_id", "text_hash")
    first = found.where("class_key IS NOT NULL").groupBy("class_key").agg(F.min(row).alias("row"))
    return _rows(docs, first.select("row").unionByName(found.where("class_key IS NULL").select(row.alias("row"))))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes; each at most once."""
    taken = mixing.mix(docs, fraction=FRACTION, epochs=1).where("copies > 0")
    return _rows(docs, taken.select(F.struct("doc_id", "text_hash", "lang", "source").alias("row")))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with their sequence and offset."""
    import public_tokenizers

    out = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def _rows(docs: DataFrame, taken: DataFrame) -> DataFrame:
    """As many rows of ``docs`` as ``taken`` has with the same ``row``: id and hash of the text, perhaps language and source; null is a value.

    Only rows that stand for themselves move: the join's keys hold the id, so a text with many copies is no hot key.
    """
    names = taken.schema["row"].dataType.names
    value = {"doc_id": F.col("doc_id").cast("long"), "text_hash": F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))), "lang": F.col("lang").cast("string"), "source": F.col("source").cast("string")}
    keys = [f"k{i}" for i in range(len(names))]
    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("whole"), *(value[c].alias(k) for k, c in zip(keys, names, strict=True)))
    # One key that is never null, so that join and window share an exchange; a second hash makes it 128 bits.
    whole = whole.withColumns({"h": F.xxhash64(*keys), "g": F.xxhash64(F.lit(7), *keys)})
    counted = taken.select(*(F.col(f"row.{c}").alias(f"t{i}") for i, c in enumerate(names))).groupBy(*(f"t{i}" for i in range(len(names)))).agg(F.count("*").alias("many"))
    there = [f"t{i}" for i in range(len(names))]
    counted = counted.select("many", F.xxhash64(*there).alias("h"), F.xxhash64(F.lit(7), *there).alias("other"))
    both = whole.join(counted, "h").where(F.col("g").bitwiseXOR(F.col("other")) == 0)
    alike = W.partitionBy("h", "g").orderBy(F.lit(0))
    return both.withColumn("alike", F.row_number().over(alike)).where("alike <= many").select("whole.*")


STAGES = [("quality classifier", quality), ("exact dedup", exact), ("n-gram Jaccard join", near), ("mixing", mixed), ("best-fit packing", packed)]
#: Several stages can't be expressed in SQL (a trained classifier, tokenizers); tests/llm/test_pipeline.py holds each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        path = shared_path(spark, f"stage{k}")
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
