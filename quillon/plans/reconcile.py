"""Subtotal and total rows of a sheet as checksums of its detail rows.

The grid is (row_idx, cells array<string>). It is read once; rows are classified by expressions; each summary row has up to three
scopes of detail rows, tried in order: rows that agree with its labels, all rows, the block before it. Each
scope is a join of its own by keys: distinct texts of a column, one sum, and the number of the block. A window picks the
first scope whose sum is within tolerance.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.text import RATIO_WORDS, has_any, is_blank, normalize_text, parse_money, strip_summary_words, summary_level
from quillon.runtime import stash

ABSOLUTE, RELATIVE = 0.5, 0.005
#: Headers are looked for in this many first rows, and numbers in this many rows below one.
HEADER_ROWS, BELOW_ROWS = 15, 20


@dataclass(frozen=True)
class Reconciliation:
    """entries: one row for each summary cell; rows: how each row was read; summary: status and counts."""

    columns: list[str]
    header_row: int
    label_index: int
    entries: DataFrame
    rows: DataFrame
    summary: DataFrame


def detect_header(g: DataFrame) -> int:
    """The first of the rows that score most: two points a cell, one more for a cell that is no number, one and a half for each
    cell's column with a number among the next rows, less half a point for each row above. ``g`` has row_idx, t, num and blank."""
    top = g.where(F.col("row_idx") < HEADER_ROWS + BELOW_ROWS).select("row_idx", F.posexplode(F.arrays_zip("num", "blank")).alias("c", "x"))
    filled = top.where((F.col("row_idx") < HEADER_ROWS) & ~F.col("x.blank")).select(F.col("row_idx").alias("i"), "c", F.col("x.num").isNull().alias("label"))
    numbers = top.where(F.col("x.num").isNotNull()).select(F.col("c").alias("k"), F.col("row_idx").alias("j"))
    below = filled.join(numbers, (F.col("c") == F.col("k")) & F.col("j").between(F.col("i") + 1, F.col("i") + BELOW_ROWS), "left").groupBy("i", "c", "label").agg(F.max(F.col("j").isNotNull()).alias("below"))
    points = 2 * F.count(F.lit(1)) + F.sum(F.col("label").cast("int")) + 1.5 * F.sum(F.col("below").cast("int")) - 0.5 * F.col("i")
    best = below.groupBy("i").agg(points.alias("points")).agg(F.min_by("i", F.struct(-F.col("points"), "i")).alias("i")).first()["i"]
    return best or 0


def column_names(header: list[str], width: int) -> list[str]:
    """One name a column, empty ones numbered; a name that is taken gets the first free suffix."""
    given = [(header[i] if i < len(header) else "").strip() or f"__col_{i + 1}" for i in range(width)]
    taken: dict[str, None] = {}
    for name in given:
        taken[next(n for k in itertools.count(1) if (n := name if k == 1 else f"{name}__{k}") not in taken)] = None
    return list(taken)


def reconcile(grid: DataFrame, absolute: float = ABSOLUTE, relative: float = RELATIVE, header_row: int | None = None) -> Reconciliation:
    grid = stash(grid.select(F.col("row_idx").cast("int").alias("row_idx"), F.transform("cells", normalize_text).alias("texts")))
    width = grid.agg(F.max(F.size("texts"))).first()[0] or 0
    g = grid.select("row_idx", F.transform(F.sequence(F.lit(1), F.lit(max(width, 1))), lambda i: F.coalesce(F.try_element_at("texts", i), F.lit(""))).alias("t"))
    g = stash(g.withColumn("num", F.transform("t", lambda x: parse_money(x)["number"])).withColumn("blank", F.transform("t", is_blank)))
    if header_row is None:
        header_row = detect_header(g)
    first = g.where(F.col("row_idx") == header_row).select("t").first()
    columns = column_names(list(first["t"]) if first else [], width)
    body = g.where(F.col("row_idx") > header_row)
    cells = body.select("row_idx", F.posexplode(F.arrays_zip("t", "num")).alias("c", "x"))
    likely = cells.groupBy("c").agg(F.sum(((F.col("x.t") != "") & F.col("x.num").isNull()).cast("int")).alias("n")).collect()
    label = min(likely, key=lambda r: (-r["n"], r["c"]))["c"] if likely else 0
    own = F.element_at("t", label + 1)
    # the first summary word of the row, where its label has none
    spots = F.transform(F.sequence(F.lit(0), F.lit(max(width, 1) - 1)), lambda i: F.struct(i.alias("at"), summary_level(F.element_at("t", i + 1)).alias("level")))
    spot = F.try_element_at(F.filter(spots, lambda s: s["level"].isNotNull()), F.lit(1))
    kind = F.when(~F.exists("blank", lambda b: ~b), "blank").when(summary_level(own).isNotNull(), summary_level(own)).when(has_any(own, RATIO_WORDS), "ratio").otherwise(F.coalesce(spot["level"], F.lit("detail")))
    at = F.when(summary_level(own).isNotNull() | has_any(own, RATIO_WORDS), F.lit(label)).otherwise(F.coalesce(spot["at"], F.lit(label)))
    rows = body.withColumn("kind", kind).withColumn("label_at", at).withColumn("label", F.element_at("t", F.col("label_at") + 1))
    # a sheet's rows in order, in one task: sheets have a bounded number of rows
    order = Window.orderBy("row_idx")
    is_summary = F.col("kind").isin("group", "total")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("block", F.coalesce(F.max(F.when(is_summary, F.col("row_idx"))).over(before), F.lit(-1))).withColumn("above", F.last(F.when(F.col("kind") == "detail", F.col("t")), True).over(before))
    rows = stash(rows.drop("blank"))
    shares = rows.where(~F.col("kind").isin("group", "total", "ratio")).select(F.posexplode("num").alias("c", "x")).groupBy("c").agg(F.count("x").alias("n"), F.count(F.lit(1)).alias("all")).collect()
    ratio = [any(w.lower() in c.lower() for w in RATIO_WORDS) for c in columns]
    value_columns = sorted(r["c"] for r in shares if r["n"] >= 1 and r["n"] >= 0.5 * r["all"] and not ratio[r["c"]])

    # conditions of a summary row: its other texts, and its label without the summary words
    indexed = F.transform("t", lambda x, i: F.struct(i.alias("c"), F.when(i == label, F.when(strip_summary_words(x) != "", strip_summary_words(x)).when(summary_level(x).isNull(), x)).when(summary_level(x).isNull(), x).alias("v"), x.alias("t")))
    kept = F.filter(F.arrays_zip(indexed.alias("p"), F.col("num").alias("num")), lambda z: (z["p"]["t"] != "") & z["num"].isNull() & z["p"]["v"].isNotNull())
    wanted = F.transform(kept, lambda z: F.struct(z["p"]["c"].alias("c"), z["p"]["v"].alias("v")))
    fallback = F.when((F.col("kind") == "group") & F.col("above").isNotNull() & (F.coalesce(F.element_at("above", F.col("label_at") + 1), F.lit("")) != ""), F.array(F.struct(F.col("label_at").alias("c"), F.element_at("above", F.col("label_at") + 1).alias("v"))))
    stated = rows.where(is_summary).select(F.col("row_idx").alias("s"), F.col("kind").alias("s_kind"), F.col("label").alias("s_label"), F.col("block").alias("s_block"), F.col("num").alias("s_num"), wanted.alias("wanted"), fallback.alias("fallback"))
    stated = stated.withColumn("wanted", F.when(F.size("wanted") > 0, F.col("wanted")).otherwise(F.coalesce("fallback", "wanted"))).drop("fallback")
    stated = stash(stated)
    details = rows.where(F.col("kind") == "detail").select("row_idx", "t", "num", "block")
    # rows that agree: texts of a column that contain a wanted one, then rows with these texts, in all wanted columns
    asked = stated.where(F.size("wanted") > 0).select("s", F.size("wanted").alias("n"), F.explode(F.array_distinct("wanted")).alias("w")).select("s", "n", "w.c", "w.v")
    wants = asked.select("c", "v").distinct()
    cells = details.select("row_idx", F.posexplode("t").alias("c", "text")).join(wants.select("c").distinct(), "c", "left_semi")
    fits = cells.select("c", "text").distinct().join(wants, "c").where(F.col("text").contains(F.col("v")))
    agree = cells.join(fits, ["c", "text"]).join(asked, ["c", "v"]).groupBy("s", "row_idx").agg(F.count(F.lit(1)).alias("met"), F.max("n").alias("n")).where(F.col("met") == F.col("n"))
    agree = agree.select("s", F.lit(1).alias("scope"), "row_idx").join(details.select("row_idx", "num"), "row_idx").select("s", "scope", "num")
    # the block before a summary row has no other one in it
    blocks = stated.select("s", F.col("s_block").alias("block")).join(details, "block").where(F.col("row_idx") < F.col("s")).select("s", F.lit(3).alias("scope"), "num")
    met = agree.unionByName(blocks)
    zero = F.array(*(total_of(c) for c in value_columns)) if value_columns else F.array().cast("array<double>")
    sums = met.groupBy("s", "scope").agg(zero.alias("sums"), F.count(F.lit(1)).alias("detail_rows"))
    # all rows have one sum
    every = details.agg(zero.alias("sums"), F.count(F.lit(1)).alias("detail_rows")).where(F.col("detail_rows") > 0)
    totals = stated.where(F.col("s_kind") == "total").select("s", F.lit(2).alias("scope"))
    sums = sums.unionByName(totals.join(F.broadcast(every)))
    entries = stated.join(sums, "s").select("s", "s_kind", "s_label", "s_num", "scope", "detail_rows", F.posexplode("sums").alias("k", "computed"))
    col_at = F.array(*map(F.lit, value_columns)) if value_columns else F.array().cast("array<int>")
    entries = entries.withColumn("c", F.element_at(col_at, F.col("k") + 1)).withColumn("stated", F.element_at("s_num", F.col("c") + 1)).where(F.col("stated").isNotNull())
    entries = entries.withColumn("diff", F.col("stated") - F.col("computed")).withColumn("ok", F.abs("diff") <= F.greatest(F.lit(float(absolute)), F.abs("stated") * float(relative)))
    pick = Window.partitionBy("s", "c").orderBy(F.col("ok").desc(), "scope")
    entries = entries.withColumn("_n", F.row_number().over(pick)).where(F.col("_n") == 1)
    name = F.element_at(F.array(*map(F.lit, columns)), F.col("c") + 1)
    entries = entries.select(
        F.format_string("R%03d", F.row_number().over(Window.orderBy("s", "c"))).alias("id"),
        (F.col("s") + 1).alias("row"),
        F.col("s_label").alias("label"),
        F.col("s_kind").alias("scope_type"),
        F.element_at(F.array(F.lit("constraints"), F.lit("all_detail"), F.lit("preceding_block")), F.col("scope")).alias("scope"),
        name.alias("column"),
        "stated",
        "computed",
        "diff",
        F.try_divide("diff", "stated").alias("diff_rate"),
        F.when(F.col("ok"), "consistent").otherwise("inconsistent").alias("status"),
        "detail_rows",
    )
    s = entries.agg(F.count(F.lit(1)).alias("checked"), F.coalesce(F.sum((F.col("status") == "inconsistent").cast("int")), F.lit(0)).alias("failed"))
    s = s.withColumn("status", F.when(F.col("checked") == 0, "no_summary_rows").when(F.col("failed") > 0, "fail").otherwise("pass")).withColumn("exit_code", (F.col("failed") > 0).cast("int"))
    return Reconciliation(columns, header_row, label, entries, rows.select(F.col("row_idx"), "kind", "label"), s)


def total_of(c: int):
    return F.coalesce(F.sum(F.element_at("num", c + 1)), F.lit(0.0))
