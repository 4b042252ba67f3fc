"""Mixing sources to target weights through a tree of domains, languages and sources.

A token budget flows from the root to the leaves in proportion to weights.  A node never gets more than its subtree can
give (``epochs`` times its tokens): what it lacks goes to its siblings first, and only if all of them are full to the
siblings of an ancestor.  Each leaf then takes whole epochs and a prefix of the next one, in an order seeded by epoch.

Everything is windows over aggregates.  Prefix sums in a leaf have two levels: by bucket of the order's hash, then
inside a bucket, so a leaf with a third of all rows is spread over ``16 ** digits`` windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import read, stored

LEVELS = ("domain", "lang", "source")
#: Weights by level and name; a name that isn't here weighs 1.
WEIGHTS = {"domain": {"d0": 4, "d1": 3, "d2": 2, "d3": 1}, "lang": {"en": 5, "de": 2, "fr": 2, "es": 1}, "source": {}}


def domain() -> Column:
    """Four domains by the number in the source's name; other and null sources are domain d0."""
    return F.concat(F.lit("d"), F.coalesce(F.pmod(F.expr("try_cast(nullif(regexp_extract(source, '([0-9]+)$', 1), '') AS bigint)"), F.lit(4)), F.lit(0)).cast("string"))


def n_tokens(text: Column) -> Column:
    """Words of a text: runs of characters other than [\\x20\\x09-\\x0D]."""
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def leaf_budgets(leaves: DataFrame, budget: Column, weights: dict = WEIGHTS, epochs: int = 4, levels: tuple = LEVELS) -> DataFrame:
    """``leaves`` (the levels, tokens) with the tokens each leaf has to give, as ``budget``.

    At each node the share of child c is min(capacity, weight * x) with x such that the shares add up to the node's
    own: children are closed in the order of capacity by weight, and x is largest where the first open child fits it.
    """

    def weight(level: str) -> Column:
        out = F.lit(1)
        for name, w in weights.get(level, {}).items():
            out = F.when(F.col(level).eqNullSafe(F.lit(name)), F.lit(w)).otherwise(out)
        return out.cast("long")

    given = leaves.agg(F.sum("tokens").alias("tokens")).select(F.coalesce(budget, F.lit(0.0)).cast("double").alias("share"))
    parents: tuple = ()
    for level in levels:
        nodes = leaves.groupBy(*parents, level).agg((F.sum("tokens") * epochs).alias("cap")).withColumn("w", weight(level))
        at = nodes.crossJoin(F.broadcast(given)) if not parents else _null_join(nodes, given, parents)
        order = W.partitionBy(*parents).orderBy(F.col("cap") / F.col("w"), level)
        at = at.withColumns({"full": F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)), "open": F.sum("w").over(order.rowsBetween(0, W.unboundedFollowing))})
        at = at.withColumn("x", (F.col("share") - F.coalesce("full", F.lit(0))) / F.col("open"))
        at = at.withColumn("x", F.max(F.when(F.col("x") <= F.col("cap") / F.col("w"), F.col("x"))).over(W.partitionBy(*parents)))
        given = at.select(*parents, level, F.when(F.col("x").isNull(), F.col("cap").cast("double")).otherwise(F.least(F.col("cap").cast("double"), F.col("w") * F.col("x"))).alias("share"))
        parents = (*parents, level)
    return _null_join(leaves, given, parents).select(*parents, "tokens", F.floor(F.col("share") + 1e-6).cast("long").alias("budget"))


def _null_join(left: DataFrame, right: DataFrame, on: tuple) -> DataFrame:
    """Inner join on columns that may be null."""
    other = right.select(*(F.col(c).alias(f"__{c}") for c in on), *(c for c in right.columns if c not in on))
    cond = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in on]
    return left.join(other, cond).drop(*(f"__{c}" for c in on))


def mix(docs: DataFrame, fraction: float = 0.8, weights: dict = WEIGHTS, epochs: int = 4, seed: int = 42, digits: int = 3) -> DataFrame:
    """How often each document is taken: doc_id, text_hash, domain, lang, source, tokens, copies.

    The budget is ``fraction`` of all tokens.  Null languages and sources are leaves of their own; null and empty texts
    have no tokens and are taken with whatever prefix they stand in.  Rows with equal ids are rows of their own.
    """
    rows = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), domain().alias("domain"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), n_tokens(F.col("text")).alias("tokens"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text_hash")), "mix-rows")
    leaves = rows.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens"))
    plan = leaf_budgets(leaves, F.col("tokens") * F.lit(fraction), weights, epochs)
    plan = plan.select(*LEVELS, F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(0).cast("long").alias("whole"), F.when(F.col("tokens") > 0, F.col("budget") % F.col("tokens")).otherwise(0).alias("rest"))
    placed = _null_join(rows, plan, LEVELS)
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("whole").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    placed = placed.withColumn("order", h).withColumn("bucket", F.substring("order", 1, digits))
    sums = placed.groupBy(*LEVELS, "bucket").agg(F.sum("tokens").alias("n"))
    before = sums.select(*LEVELS, "bucket", (F.sum("n").over(W.partitionBy(*LEVELS).orderBy("bucket")) - F.col("n")).alias("before"))
    inside = F.sum("tokens").over(W.partitionBy(*LEVELS, "bucket").orderBy("order", "doc_id", "tokens", "text_hash").rowsBetween(W.unboundedPreceding, 0))
    ranked = _null_join(placed.withColumn("inside", inside), before, (*LEVELS, "bucket"))
    return ranked.select("doc_id", "text_hash", *LEVELS, "tokens", (F.col("whole") + (F.col("before") + F.col("inside") <= F.col("rest")).cast("long")).alias("copies"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents")).drop("text_hash")


def sql(table: str = "documents", fraction: float = 0.8, weights: dict = WEIGHTS, epochs: int = 4, seed: int = 42) -> str:
    """The same as DuckDB SQL, with one window a leaf."""

    def weight(level: str) -> str:
        cases = "".join(f" WHEN '{n}' THEN {w}" for n, w in weights.get(level, {}).items())
        return f"CASE {level}{cases} ELSE 1 END" if cases else "1"

    out = f"""WITH rows_ AS (SELECT doc_id, 'd' || coalesce(try_cast(nullif(regexp_extract(source, '([0-9]+)$', 1), '') AS BIGINT) % 4, 0) AS domain, lang, source,
  CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS tokens FROM {table}),
leaves AS (SELECT domain, lang, source, CAST(sum(tokens) AS BIGINT) AS tokens FROM rows_ GROUP BY ALL),
given0 AS (SELECT CAST(sum(tokens) AS DOUBLE) * CAST({fraction} AS DOUBLE) AS share FROM leaves)"""
    parents: list[str] = []
    for k, level in enumerate(LEVELS, 1):
        by = ", ".join([*parents, level])
        part = f"PARTITION BY {', '.join(parents)}" if parents else ""
        on = " AND ".join(f"n.{p} IS NOT DISTINCT FROM g.{p}" for p in parents) or "true"
        cols = ", ".join(f"n.{c}" for c in [*parents, level])
        out += f""",
nodes{k} AS (SELECT {by}, CAST(sum(tokens) * {epochs} AS DOUBLE) AS cap, CAST({weight(level)} AS DOUBLE) AS w FROM leaves GROUP BY {by}),
at{k} AS (SELECT {cols}, cap, w, share, coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled, sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_
  FROM nodes{k} n JOIN given{k - 1} g ON {on} WINDOW o AS ({part.replace('BY ', 'BY n.', 1).replace(', ', ', n.') if part else ''} ORDER BY cap / w, n.{level} NULLS FIRST)),
x{k} AS (SELECT {by}, cap, w, max(CASE WHEN (share - filled) / open_ <= cap / w THEN (share - filled) / open_ END) OVER ({part}) AS x FROM at{k}),
given{k} AS (SELECT {by}, CASE WHEN x IS NULL THEN cap ELSE least(cap, w * x) END AS share FROM x{k})"""
        parents.append(level)
    on = " AND ".join(f"r.{c} IS NOT DISTINCT FROM p.{c}" for c in LEVELS)
    out += f""",
plan AS (SELECT l.*, CAST(floor(share + 1e-6) AS BIGINT) AS budget FROM leaves l JOIN given3 g ON {on.replace('r.', 'l.').replace('p.', 'g.')}),
placed AS (SELECT r.*, CASE WHEN p.tokens > 0 THEN budget // p.tokens ELSE 0 END AS whole, CASE WHEN p.tokens > 0 THEN budget % p.tokens ELSE 0 END AS rest FROM rows_ r JOIN plan p ON {on}),
ordered AS (SELECT *, md5('{seed}:' || whole || ':' || coalesce(CAST(doc_id AS VARCHAR), '')) AS order_ FROM placed)
SELECT doc_id, domain, lang, source, tokens, CAST(whole + CASE WHEN sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY order_, doc_id, tokens ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) <= rest THEN 1 ELSE 0 END AS BIGINT) AS copies FROM ordered"""
    return out


QUERIES = {"op9_mixing": op9_mixing}
SQL = {"op9_mixing": sql()}
