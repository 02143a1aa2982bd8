"""Held-out folds and bounded training samples."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: At most this many labels are learnt, the commonest (ties: the smallest), and this many bytes of text for each.
MOST_VALUES, MOST_BYTES = 256, 16 << 20
_SPACE = 1 << 62


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds))


def held_out(doc_id: Column, folds: int, at: int) -> Column:
    return F.coalesce(fold(doc_id, folds) == at, F.lit(False))


def label_counts(rows: DataFrame, by: str) -> dict:
    """The commonest values of ``by`` and how many rows have them; at most MOST_VALUES."""
    some = rows.where(F.col(by).isNotNull()).groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    return {r[by]: r["n"] for r in some.orderBy(F.desc("n"), by).limit(MOST_VALUES).collect()}


def bounded_sample(rows: DataFrame, by: str, most: int, seed: int = 11) -> tuple[DataFrame, dict]:
    """(doc_id, label, at): the ``most`` ids with the smallest hashes ``at`` for each value of ``by`` (all, if there are
    fewer; fewer where rows repeat ids, since rows are counted), and the values' counts.

    ``rows`` has doc_id and ``by``. A hash bound lets about ``most`` rows of each value through wherever they lie, and only
    those are ranked, so the sample does not depend on partitions or order and stays bounded for any number of rows. An id
    with several labels is in the sample of each that picks it.
    """
    counts = label_counts(rows, by)
    if not counts:
        return rows.limit(0).select("doc_id", F.col(by).alias("label"), F.lit(0).cast("bigint").alias("at")), counts
    reach = most + 8 * most**0.5 + 16
    bounds = [(value, int(_SPACE * min(1.0, reach / n))) for value, n in counts.items()]
    cuts = rows.sparkSession.createDataFrame(bounds, f"label {dict(rows.dtypes)[by]}, cut long")
    at = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id")), 2)
    near = rows.select("doc_id", F.col(by).alias("label"), at.alias("at")).join(F.broadcast(cuts), "label").where(F.col("at") < F.col("cut"))
    rank = F.row_number().over(Window.partitionBy("label").orderBy("at", "doc_id"))
    return near.select("doc_id", "label", "at").distinct().withColumn("_r", rank).where(F.col("_r") <= most).drop("_r"), counts


def training_texts(docs: DataFrame, picks: DataFrame, most: int, by: str | None = None, most_bytes: int = MOST_BYTES) -> pd.DataFrame:
    """(doc_id, label, text) of the picked ids, each label's in the order of their hashes for as long as their texts have
    no more than ``most_bytes`` together: the bound is on rows, and each row's text is whole.

    ``docs`` has doc_id and text, and ``by`` if the label is in the documents: then only rows of the picked label count.
    Null texts do not. The result has at most ``most`` rows and ``most_bytes`` of text for each label, in a fixed order.
    """
    small = F.broadcast(picks.withColumnsRenamed({"doc_id": "_id"}))
    on = F.col("doc_id") == F.col("_id")
    got = docs.join(small, on & (F.col(by) == F.col("label")) if by else on).where(F.col("text").isNotNull()).select("doc_id", "label", "at", "text")
    order = Window.partitionBy("label").orderBy("at", "doc_id", "text")
    got = got.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= most)
    got = got.withColumn("_b", F.sum(F.octet_length("text")).over(order.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("_b") <= most_bytes)
    return got.select("doc_id", "label", "at", "text").toPandas().sort_values(["at", "doc_id", "label", "text"], kind="stable").drop(columns="at").drop_duplicates().reset_index(drop=True)


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, most: int, folds: int, held_fold: int, seed: int = 11) -> tuple[pd.DataFrame, dict]:
    """Training rows for a label of 0 and 1 in ``labels``, outside the held-out fold; and the classes' counts there."""
    usable = labels.where(F.col(label).isin(0, 1) & (fold(F.col("doc_id"), folds) != held_fold)).select("doc_id", label)
    picks, counts = bounded_sample(usable, label, most, seed)
    return training_texts(docs.select("doc_id", "text"), picks, most), counts
