"""A training corpus from raw documents: language ID, toxicity, near-duplicates, benchmark leaks, source mix.

Each stage takes (spark, docs, sf_dir) and returns the documents that it keeps, with the columns that they came
with; the last one returns each document as often as the mix takes it, numbered in ``copy``. ``run`` writes each
stage's documents to shared storage and the next one reads them from there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm import decontaminate, dedup, lang_id, mixing, toxicity
from quillon.runtime import stash, table

#: A text is rejected if it has no letters or no learned language is this likely.
LEAST_LANGUAGE = 0.3
#: Decisions on up to this many documents are sent to all executors; more are joined by shuffle.
BROADCAST_ROWS = 200_000


def _columns(docs: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in docs.columns]


def _packed(docs: DataFrame, *more: Column) -> DataFrame:
    """Each row whole in ``row``, so that no name of its columns meets one of ours, beside what decisions need."""
    return docs.select(F.struct(*_columns(docs)).alias("row"), *more)


def _pick(packed: DataFrame, decided: DataFrame, keys: list[str], how: str) -> DataFrame:
    """``packed`` joined with stored decisions on ``keys``, where null equals null."""
    right = decided.withColumnsRenamed({k: f"_{k}" for k in keys})
    right = F.broadcast(right) if decided.count() <= BROADCAST_ROWS else right
    return packed.join(right, [packed[k].eqNullSafe(right[f"_{k}"]) for k in keys], how)


def _hash() -> Column:
    return F.xxhash64("text").alias("th")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language stay. Null, empty and letterless texts go; so do texts of which no language is as
    likely as LEAST_LANGUAGE. Each row is decided by its text alone, so repeated rows stay or go together, null ids are ids like
    others, and an empty table stays empty. Without any learned language all goes."""
    got = lang_id.identify(_packed(docs, F.col("text").alias("text")), lang_id.train(docs))
    return got.where((F.col("lang_pred") != lang_id.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE)).select("row.*")


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold stay, those just at it go. Null, empty and wordless texts score like clean ones
    and stay. Rows are decided by their texts alone; an empty table stays empty."""
    got = toxicity.score_toxicity(_packed(docs, F.col("text").alias("text")), toxicity.train(docs, table(spark, sf_dir, "labels")))
    return got.where(F.col("score") < toxicity.THRESHOLD).select("row.*")


def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one with the smallest id (none comes last), once.

    Where an id is repeated or null, rows are told apart by numbers of their own, and decisions are on rows; ties go by the
    text's hash and the source. Texts without words, null ones too, are in no group: one row for each id and text stays.
    """
    again = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) | F.col("doc_id").isNull())
    if again.isEmpty():
        gone = stash(dedup.near_duplicates(docs.select("doc_id", "text"))).where(~F.col("kept")).select("doc_id")
        return _pick(_packed(docs, F.col("doc_id")), gone, ["doc_id"], "left_anti").select("row.*")
    rows = stash(_packed(docs, F.col("doc_id"), F.col("text"), F.col("source"), _hash(), F.monotonically_increasing_id().alias("node")))
    got = dedup.near_duplicates(rows.select("node", "text"), "node").select(F.col("doc_id").alias("node"), "component_id")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th", "source", "node")
    firsts = rows.select("doc_id", "th", "source", "node").join(got, "node").groupBy("component_id").agg(F.min(order).alias("first"))
    kept = stash(firsts.groupBy("first.doc_id", "first.th").agg(F.min("first").alias("first")).select("first.node"))
    return _pick(rows.select("row", "node"), kept, ["node"], "left_semi").select("row.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with no phrase of the benchmark stay, whatever stands near. Null and empty texts have none and stay; rows are
    decided by id and text, so repeated rows and null ids go where their texts do; an empty benchmark drops nothing."""
    got = decontaminate.contamination(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    bad = stash(got.where("contaminated").select("doc_id", F.col("_th").alias("th")).distinct())
    return _pick(_packed(docs, F.col("doc_id"), _hash()), bad, ["doc_id", "th"], "left_anti").select("row.*")


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, numbered from 1 in ``copy`` (which replaces a column of that name).

    Rows that agree in id, text and source share the copies of all of them evenly: equal rows are counted before they meet, so
    many repeats are no hot group. Texts without words are not taken; null sources are a source, the last; an empty table stays empty.
    """
    docs = docs.drop("copy")
    sizes = stash(docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"), _hash()))
    keys = ["doc_id", "th", "source"]
    taken = mixing.mix(sizes).groupBy(*keys).agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("rows"))
    got = _pick(_packed(docs, F.col("doc_id"), _hash(), F.col("source")), stash(taken.where(F.col("copies") > 0)), keys, "inner")
    once = got.where(F.col("rows") == 1).select("row", "copies")
    again = got.where(F.col("rows") > 1).groupBy(*keys, "row", "copies", "rows").agg(F.count(F.lit(1)).alias("k"))
    upto = F.sum("k").over(Window.partitionBy(*keys).orderBy("row"))
    share = lambda n: F.floor(F.col("copies") * n / F.col("rows"))
    again = again.withColumn("upto", upto).select("row", (share(F.col("upto")) - share(F.col("upto") - F.col("k"))).alias("copies")).where(F.col("copies") > 0)
    return once.unionByName(again).select("row.*", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))


STAGES = [
    ("language_id", language_id),
    ("toxicity", toxic),
    ("minhash_dedup", minhash_dedup),
    ("decontamination", decontamination),
    ("source_mix", source_mix),
]

#: Two stages are trained classifiers, which SQL can't express; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir))
    return docs
