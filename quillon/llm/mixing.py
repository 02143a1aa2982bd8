"""Mixing sources to target weights by systematic sampling.

Targets: sources in code point order (null last) weigh 5, 2, 1, 5, 2, 1, ...; they share ``budget`` of all words
by weight, none above ``most`` times its own size, what is cut off being reshared among the others. The fixed
point of that is min(most * size, level * weight) with one level for all, found with prefix sums over sources.

Copies: a source's documents stand in a fixed order; each expects target / size copies, and the prefix sum of
these expectations plus one random offset of the source crosses integer boundaries. A document is emitted once for
each boundary that falls into its own interval, so it gets the floor or the ceiling of its expectation. The order
runs by size class, then by a hash, then by size: a source's taken words stay close to its target, and because
the rank within a source is the rank within a (source, size class, hash) block plus the blocks before it, no task
ever needs all rows of a source. Blocks are at most SUBBLOCKS for each size class, whatever the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.runtime import stash, table

WEIGHTS = (5.0, 2.0, 1.0)
BUDGET, MOST = 1.5, 2.0
SEED = "mix-1"
SUBBLOCKS = 4096
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def _unit(text: Column) -> Column:
    """A number in [0, 1) from the md5 of a string."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("bigint") / F.lit(float(16**8))


def _source_key(source: Column) -> Column:
    """Never null, and ordered as sources are: by code point, null last."""
    return F.coalesce(F.concat(F.lit("0"), source.cast("string")), F.lit("1"))


def source_targets(sizes: DataFrame, weights=WEIGHTS, budget: float = BUDGET, most: float = MOST) -> DataFrame:
    """(_src, source_size, target) from (_src, size) rows; one row for each source."""
    w = sizes.groupBy("_src").agg(F.sum("size").alias("source_size"))
    place = F.pmod(F.row_number().over(Window.orderBy("_src")) - 1, F.lit(len(weights))) + 1
    w = w.withColumn("_weight", F.element_at(F.array(*map(F.lit, weights)), place.cast("int"))).withColumn("_cap", F.col("source_size") * F.lit(most)).withColumn("_ratio", F.col("_cap") / F.col("_weight"))
    order = Window.orderBy("_ratio", "_src")
    every = Window.orderBy("_ratio", "_src").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    capped = F.coalesce(F.sum("_cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    w = w.withColumn("_level", (F.sum("source_size").over(every) * F.lit(budget) - capped) / F.sum("_weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
    # the first source whose cap is not reached sets the level of all after it
    first = F.min(F.when(F.col("_level") * F.col("_weight") <= F.col("_cap"), F.struct("_ratio", "_src", "_level"))).over(every)
    return w.select("_src", "source_size", F.coalesce(F.least(F.col("_cap"), first["_level"] * F.col("_weight")), F.col("_cap")).alias("target"))


def mix(sizes: DataFrame, seed: str = SEED, **how) -> DataFrame:
    """``sizes`` (doc_id, source, size and any more columns) with source_size, target, copies and taken added.

    Size 0: no copies. Null source: a source of its own, last. Null doc_id: a document like others. Rows that
    agree in doc_id and size are interchangeable, so repeated rows do not make results vary between runs. An
    empty table gives no rows. Columns of ``sizes`` named like the added ones are replaced.
    ``sizes`` is read twice: give a narrow or stored table.
    """
    sizes = sizes.drop("source_size", "target", "copies", "taken")
    lead = F.length(F.col("size").cast("string")) * 100 + F.substring(F.col("size").cast("string"), 1, 2).cast("int")
    key = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"))
    held = sizes.withColumn("_src", _source_key(F.col("source"))).withColumn("_class", lead.cast("int")).withColumn("_hash", key)
    held = held.withColumn("_sub", F.pmod(F.conv(F.substring("_hash", 1, 6), 16, 10).cast("bigint"), F.lit(SUBBLOCKS)).cast("int"))
    totals = source_targets(held.select("_src", "size"), **how)
    totals = totals.select("_src", "source_size", "target", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("_rate"), _unit(F.concat(F.lit(f"{seed}|"), F.col("_src"))).alias("_offset"))
    block = ["_src", "_class", "_sub"]
    blocks = held.groupBy(*block).agg(F.sum(F.when(F.col("size") > 0, 1).otherwise(0)).alias("_n"))
    earlier = Window.partitionBy("_src").orderBy("_class", "_sub").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n").join(totals, "_src")
    ranked = held.withColumn("_rank", F.row_number().over(Window.partitionBy(*block).orderBy("size", "_hash")))
    out = ranked.join(blocks, block)
    last = F.floor(F.col("_offset") + F.col("_rate") * (F.col("_before") + F.col("_rank")))
    prior = F.floor(F.col("_offset") + F.col("_rate") * (F.col("_before") + F.col("_rank") - 1))
    out = out.withColumn("copies", F.when(F.col("size") > 0, last - prior).otherwise(0).cast("bigint")).withColumn("taken", F.col("copies") * F.col("size"))
    return out.select(*sizes.columns, "source_size", "target", "copies", "taken")


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its source's target and the words that the mix takes of it."""
    docs = table(spark, sf_dir, "documents")
    sizes = stash(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")))
    return mix(sizes).select("doc_id", "size", "source_size", "target", "taken", "copies", "source")


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS src,
    CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    md5('mix-1|' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h
  FROM documents
), s AS (SELECT src, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY src),
w AS (
  SELECT src, source_size, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY src) - 1) % 3 + 1)::INT] AS weight, source_size * 2.0::DOUBLE AS cap FROM s
), l AS (
  SELECT *, cap / weight AS ratio, (CAST(sum(source_size) OVER () AS DOUBLE) * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
    / sum(weight) OVER (ORDER BY cap / weight, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w
), t AS (
  SELECT src, source_size, coalesce(least(cap, weight * (SELECT level FROM l WHERE level * weight <= cap ORDER BY ratio, src LIMIT 1)), cap) AS target FROM l
), r AS (
  SELECT d.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS rate,
    CAST(('0x' || substr(md5('mix-1|' || d.src), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE AS u,
    CAST(sum(CASE WHEN size > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY d.src ORDER BY length(CAST(size AS VARCHAR)) * 100 + CAST(substr(CAST(size AS VARCHAR), 1, 2) AS INT), CAST(('0x' || substr(h, 1, 6)) AS BIGINT) % 4096, size, h ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS n
  FROM d JOIN t USING (src)
)
SELECT doc_id, size, source_size, target, CAST(CASE WHEN size > 0 THEN floor(u + rate * n) - floor(u + rate * (n - 1)) ELSE 0 END AS BIGINT) * size AS taken,
  CAST(CASE WHEN size > 0 THEN floor(u + rate * n) - floor(u + rate * (n - 1)) ELSE 0 END AS BIGINT) AS copies, source
FROM r
"""
