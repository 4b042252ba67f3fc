"""URL rules by a sort-merge range join.

A host's labels in reverse (``net.example.blog.``) are its key, so a host and its subdomains are one interval of keys.  Pages and
rules are sorted by key in ranges of about equal size; a rule goes to each range that its interval meets.  A sweep through a sorted range
keeps the stack of rules whose intervals are open, the innermost on top: as such intervals nest, a page's rules are all on the stack.
A page's path picks the longest of them.

Ranges are cut at keys of a random sample of pages, of some 64 a range; the sample decides only where a range ends.  Pages of one host are
told apart by a hash, so a host with a third of all pages is spread over many ranges.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, tidied

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
SAMPLE = 64
#: Keys are compared whole; only the borders of ranges are cut to so many characters.
BORDER_CHARS = 256


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://`` or for null."""
    part = lambda k: F.coalesce(F.regexp_extract(url, URL, k), F.lit(""))
    return F.translate(part(1), UPPER, LOWER), part(2)


def host_key(host: Column) -> Column:
    """Labels in reverse, each with a dot after it; the empty host's key is empty and its interval is everything."""
    return F.when(host == "", "").otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")))


class Sweep:
    """The stack of open rules at a place in the order of keys.  A level has the rules of one host: {path: (rule, verdict)}."""

    def __init__(self):
        self.stack: list[tuple[str, dict[str, tuple[str, str]]]] = []

    def move(self, key: str) -> None:
        """Close the rules whose interval ends before ``key``."""
        while self.stack and not key.startswith(self.stack[-1][0]):
            self.stack.pop()

    def open(self, key: str, path: str, rule: str, verdict: str) -> None:
        self.move(key)
        if not self.stack or self.stack[-1][0] != key:
            self.stack.append((key, {}))
        level = self.stack[-1][1]
        if path not in level or verdict == "block":
            level[path] = (rule, verdict)

    def active(self, key: str) -> list[tuple[list[int], dict[str, tuple[str, str]]]]:
        """Levels that hold for ``key``, outermost first, with the lengths of their paths, longest first."""
        self.move(key)
        return [(sorted({len(p) for p in level}, reverse=True), level) for _, level in self.stack]


def longest(active: list[tuple[list[int], dict[str, tuple[str, str]]]], path: str) -> tuple[str, str] | None:
    best = None
    for sizes, level in active:
        got = next((x for n in sizes if n <= len(path) and (x := level.get(path[:n]))), None)
        if got and (best is None or len(got[0]) >= len(best[0])):
            best = got
    return best


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", parts: int | None = None) -> DataFrame:
    """Per row of ``pages`` (page_id, url): page_id, host, path, rule, verdict.

    ``rules`` has host, path and verdict (allow or block).  A rule fits its host and all subdomains where the URL's path starts
    with its own.  The longest one (host and path together) wins, of equally long ones that of the longer host, and block wins if
    the same rule is there with both verdicts.  Without a rule, ``rule`` is null and the verdict ``default``.

    Null URLs, and those without ``://``, have an empty host and path, which only a rule with an empty host fits.  A rule's null host
    or path is empty.  Repeated rows stay rows of their own; very long URLs are judged whole; other columns are left out, whatever their
    names; empty tables give empty results or the default.  A task holds the rules of a host and of the domains above it, no pages.
    """
    spark = pages.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    host, path = host_and_path(F.col("url").cast("string"))
    url = pages.select(F.col("page_id").alias("page_id"), host.alias("host"), path.alias("path"), F.xxhash64("page_id", F.col("url").cast("string")).alias("salt")).withColumn("key", host_key(F.col("host")))
    many = pages.count()
    some = url.sample(fraction=min(1.0, SAMPLE * parts / max(many, 1)), seed=42).select(F.substring("key", 1, BORDER_CHARS).alias("key"), "salt").collect()
    some = sorted((r.key, r.salt) for r in some)
    borders = sorted(set(some[SAMPLE::SAMPLE]))  # fewer than two a part
    shared = spark.sparkContext.broadcast(borders)
    least = -(1 << 63)

    @F.arrow_udf("int")
    def part_of(keys: pa.Array, salts: pa.Array) -> pa.Array:
        return pa.array([bisect_right(shared.value, x) for x in zip(keys.to_pylist(), salts.to_pylist(), strict=True)], pa.int32())

    @F.arrow_udf("array<int>")
    def parts_of(starts: pa.Array) -> pa.Array:
        at = shared.value
        out = []
        for start in starts.to_pylist():
            last = bisect_left(at, (start[:-1] + "/", least)) if start else len(at)  # "/" follows "."
            out.append(list(range(bisect_right(at, (start, least)), last + 1)))
        return pa.array(out, pa.list_(pa.int32()))

    clean = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rule = rules.select(F.translate(clean("host"), UPPER, LOWER).alias("host"), clean("path").alias("path"), F.col("verdict").cast("string").alias("verdict"))
    rule = rule.withColumn("key", host_key(F.col("host"))).withColumn("part", F.explode(parts_of("key")))
    kind = dict(url.dtypes)["page_id"]
    both = url.select("page_id", "host", "path", F.lit(None).cast("string").alias("verdict"), "key", part_of("key", "salt").alias("part"), F.lit(1).alias("page"))
    both = both.unionByName(rule.select(F.lit(None).cast(kind).alias("page_id"), "host", "path", "verdict", "key", "part", F.lit(0).alias("page")))
    ordered = both.repartitionById(max(parts, len(borders) + 1), "part").sortWithinPartitions("part", "key", "page")

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, here, key, active = Sweep(), None, None, []
        for b in batches:
            keep, names, verdicts = [], [], []
            columns = (b.column(c).to_pylist() for c in ("part", "key", "page", "host", "path", "verdict"))
            for k, (part, now, page, host, path, verdict) in enumerate(zip(*columns, strict=True)):
                if part != here:
                    at, here, key = Sweep(), part, None
                if not page:
                    at.open(now, path, host + path, verdict)
                    key = None
                    continue
                if now != key:
                    key, active = now, at.active(now)
                got = longest(active, path) if active else None
                keep.append(k)
                names.append(got and got[0])
                verdicts.append(got[1] if got else default)
            some = b.select(["page_id", "host", "path"]).take(pa.array(keep, pa.int64()))
            yield pa.record_batch([*some.columns, pa.array(names, pa.string()), pa.array(verdicts, pa.string())], names=["page_id", "host", "path", "rule", "verdict"])

    return ordered.mapInArrow(tidied(sweep), f"page_id {kind}, host string, path string, rule string, verdict string")


def op11_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "pages"), spark.createDataFrame(list(RULES), "host string, path string, verdict string"))


QUERIES = {"op11_url_rules": op11_url_rules}
SQL = {
    "op11_url_rules": r"""WITH p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
r AS (SELECT host || path AS rule, * FROM (VALUES """
    + ", ".join(map(str, RULES))
    + """) v(host, path, verdict)),
j AS (SELECT page_id, p.host, p.path, (SELECT max_by(struct_pack(rule, verdict), length(rule)) FROM r WHERE (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)) AS best FROM p)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict FROM j"""
}
