"""Scan of JSON arrays that hold one object a line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def json_lines(spark: SparkSession, path: str, schema: str, files: bool = False) -> DataFrame:
    """Rows (good, row, with ``files`` also file): each line without its trailing comma, parsed; lines of brackets and empty ones are left out."""
    text = F.rtrim(F.regexp_replace(F.trim(F.col("value")), ",\\s*$", ""))
    name = [F.col("_metadata.file_path").alias("file")] if files else []
    lines = spark.read.text(path).select(text.alias("t"), *name).where("t NOT IN ('', '[', ']')")
    parsed = lines.select(F.from_json("t", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("row"), *lines.columns[1:])
    return parsed.select(F.col("row._bad").isNull().alias("good"), F.col("row").dropFields("_bad").alias("row"), *lines.columns[1:])
