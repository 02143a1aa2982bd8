"""Funnel rates, contribution, ratio decomposition, A/B effect, segment profile and anomaly scan."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.config import InputError, Result, limitations, need, predicate
from quillon.functions.exprs import array_mean, array_median, array_std, col, div, num, total, typed_day
from quillon.functions.stats import critical, normal_p
from quillon.registry import operator


def every():
    """The window of all rows; for tables of a few rows."""
    return Window.partitionBy()


@operator("funnel_rates")
def funnel_rates(df: DataFrame, stages: Sequence[str | Mapping[str, str]]) -> Result:
    """Each stage's sum, its share of the stage before and what was lost. One aggregate for all stages."""
    named = [(s["field"], s.get("name", s["field"])) if isinstance(s, Mapping) else (s, s) for s in stages]
    if len(named) < 2:
        raise InputError("a funnel needs two stages at least")
    need(df, *(f for f, _ in named))
    sums = df.agg(*(total(num(f)).alias(f"_{i}") for i, (f, _) in enumerate(named)))
    rows = []
    for i, (_, name) in enumerate(named):
        before = F.col(f"_{i - 1}") if i else F.lit(None).cast("double")
        rows.append(F.struct(F.lit(i + 1).alias("position"), F.lit(name).alias("stage"), F.col(f"_{i}").alias("count"), div(F.col(f"_{i}"), before).alias("rate_from_previous"), (before - F.col(f"_{i}")).alias("loss")))
    out = sums.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    return Result({"rows": out}, limitations(df, "funnel_rates", [("FUNNEL_NOT_DEDUPED", "stages are sums of their fields; entities are not deduplicated")], [(out, F.col("rate_from_previous") > 1, "FUNNEL_RATE_GT_1", "a stage is larger than the one before it")]))


def _two_sides(df: DataFrame, group: str, values: Mapping[str, Column], current: Mapping | None, baseline: Mapping | None) -> DataFrame:
    """Each group's sums on both sides in one pass; groups that are on neither side are left out."""
    on, off = predicate(df, current), predicate(df, baseline)
    aggs = [F.coalesce(F.sum(F.when(side, v)), F.lit(0.0)).alias(f"{name}_{tag}") for name, v in values.items() for tag, side in (("baseline", off), ("current", on))]
    return df.where(on | off).groupBy(col(group).alias("group")).agg(*aggs)


@operator("contribution")
def contribution(df: DataFrame, group_field: str, value_field: str, current_filter: Mapping[str, Any] | None = None, baseline_filter: Mapping[str, Any] | None = None) -> Result:
    """What each group adds to the change of a sum. A null group is one group."""
    need(df, group_field, value_field)
    sums = _two_sides(df, group_field, {"v": num(value_field)}, current_filter, baseline_filter)
    delta = F.col("v_current") - F.col("v_baseline")
    rows = sums.select(
        F.format_string("C-%03d", F.row_number().over(Window.orderBy(F.col("group").cast("string").asc_nulls_last()))).alias("evidence_id"),
        "group",
        F.col("v_baseline").alias("baseline"),
        F.col("v_current").alias("current"),
        delta.alias("delta"),
        div(delta, F.sum(delta).over(every())).alias("share_of_gap"),
    )
    summary = sums.agg(total(F.col("v_baseline")).alias("baseline"), total(F.col("v_current")).alias("current")).withColumn("gap", F.col("current") - F.col("baseline"))
    return Result({"rows": rows, "summary": summary}, limitations(df, "contribution", [("GROUPS_MUST_BE_ADDITIVE", "groups have to be disjoint and additive")], [(rows.agg(F.min("delta").alias("a"), F.max("delta").alias("b")), (F.col("a") < 0) & (F.col("b") > 0), "GAP_OFFSETTING", "groups move in both directions: shares can pass 100 %")]))


@operator("ratio_decomp")
def ratio_decomp(df: DataFrame, group_field: str, numerator_field: str, denominator_field: str, current_filter: Mapping[str, Any] | None = None, baseline_filter: Mapping[str, Any] | None = None) -> Result:
    """The change of a ratio, split into each group's rate (within) and weight (mix) and what is left over."""
    need(df, group_field, numerator_field, denominator_field)
    s = _two_sides(df, group_field, {"n": num(numerator_field), "d": num(denominator_field)}, current_filter, baseline_filter)
    rate = {t: div(F.col(f"n_{t}"), F.col(f"d_{t}")) for t in ("baseline", "current")}
    weight = {t: div(F.col(f"d_{t}"), F.sum(f"d_{t}").over(every())) for t in ("baseline", "current")}
    r = s.select("group", *(v.alias(f"rate_{t}") for t, v in rate.items()), *(F.coalesce(v, F.lit(0.0)).alias(f"weight_{t}") for t, v in weight.items()))
    within = F.coalesce(F.col("weight_baseline") * (F.col("rate_current") - F.col("rate_baseline")), F.lit(0.0))
    mix = F.coalesce((F.col("weight_current") - F.col("weight_baseline")) * F.col("rate_baseline"), F.lit(0.0))
    rows = r.withColumn("within", within).withColumn("mix", mix).withColumn("contribution", F.col("within") + F.col("mix"))
    totals = s.agg(div(F.sum("n_baseline"), F.sum("d_baseline")).alias("rate_baseline"), div(F.sum("n_current"), F.sum("d_current")).alias("rate_current"))
    parts = rows.agg(total(F.col("within")).alias("within_total"), total(F.col("mix")).alias("mix_total"))
    # two rows of one row each
    summary = totals.join(parts, F.lit(True)).withColumn("rate_delta", F.col("rate_current") - F.col("rate_baseline")).withColumn("interaction_residual", F.col("rate_delta") - F.col("within_total") - F.col("mix_total"))
    return Result({"rows": rows, "summary": summary}, limitations(df, "ratio_decomp", [("DECOMP_NOT_CAUSAL", "an accounting split, not a cause"), ("INTERACTION_RESIDUAL", "new groups and joint changes are in the residual")]))


def arm_moments(df: DataFrame, arm: Column, values: Mapping[str, Column], arms: Sequence[str]) -> DataFrame:
    """One row with n, mean and sample variance of each value in each arm, in one pass. Arms compare as text."""
    name = arm.cast("string")
    aggs = []
    for key, v in values.items():
        for tag, want in zip(("c", "t"), arms, strict=True):
            x = F.when(name == want, v)
            aggs += [F.count(x).cast("double").alias(f"n_{key}_{tag}"), F.avg(x).alias(f"mean_{key}_{tag}"), F.var_samp(x).alias(f"var_{key}_{tag}")]
    return df.agg(*aggs)


def welch(row: DataFrame, key: str, z_crit: float, binary: bool = False) -> list[Column]:
    """effect, se, z, ci_low, ci_high and p_value columns from arm_moments."""
    n, m, v = ({t: F.col(f"{k}_{key}_{t}") for t in "ct"} for k in ("n", "mean", "var"))
    effect = m["t"] - m["c"]
    if binary:
        p = div(m["c"] * n["c"] + m["t"] * n["t"], n["c"] + n["t"])
        se = F.sqrt(p * (1 - p) * (div(F.lit(1.0), n["c"]) + div(F.lit(1.0), n["t"])))
    else:
        se = F.sqrt(div(v["c"], n["c"]) + div(v["t"], n["t"]))
    z = div(effect, se)
    return [effect.alias("effect"), se.alias("se"), z.alias("z"), (effect - z_crit * se).alias("ci_low"), (effect + z_crit * se).alias("ci_high"), normal_p(z).alias("p_value")]


@operator("ab_effect")
def ab_effect(df: DataFrame, variant_field: str, metric_field: str, control: str = "A", treatment: str = "B", metric_type: str = "binary", confidence_level: float = 0.95) -> Result:
    """Difference of two arms' means: pooled for a binary metric, else Welch."""
    need(df, variant_field, metric_field)
    if metric_type not in ("binary", "continuous"):
        raise InputError("metric_type has to be binary or continuous")
    m = arm_moments(df, col(variant_field), {"x": num(metric_field)}, (str(control), str(treatment)))
    out = m.select(F.col("n_x_c").alias("control_n"), F.col("n_x_t").alias("treatment_n"), F.col("mean_x_c").alias("control_mean"), F.col("mean_x_t").alias("treatment_mean"), *welch(m, "x", critical(confidence_level), metric_type == "binary"), div(F.col("mean_x_t") - F.col("mean_x_c"), F.col("mean_x_c")).alias("relative_effect"))
    notes = [("AB_NO_SRM", "the split of the sample is not checked here"), ("AB_NORMAL_APPROX", "normal approximation")] + [("AB_POOLED_SE", "pooled standard error")] * (metric_type == "binary")
    return Result({"summary": out}, limitations(df, "ab_effect", notes, [(out, (F.col("control_n") == 0) | (F.col("treatment_n") == 0), "AB_EMPTY_ARM", "an arm has no rows")]))


@operator("segment_profile")
def segment_profile(df: DataFrame, segment_field: str, metrics: Sequence[Mapping[str, str]] = ()) -> Result:
    """Size, share and metrics of each segment; null is a segment."""
    need(df, segment_field, *(m["field"] for m in metrics))
    how = {"sum": lambda f: total(num(f)), "mean": lambda f: F.avg(num(f))}
    aggs = [how.get(m.get("agg", "count"), lambda f: F.count(col(f)))(m["field"]).alias(m.get("name") or f"{m['field']}_{m.get('agg', 'count')}") for m in metrics]
    rows = df.groupBy(col(segment_field).alias("segment")).agg(F.count(F.lit(1)).alias("size"), *aggs)
    rows = rows.withColumn("share", div(F.col("size").cast("double"), F.sum("size").over(every()).cast("double")))
    return Result({"rows": rows}, limitations(df, "segment_profile", [("SEGMENT_DESCRIPTIVE", "segments are described, not explained")]))


def daily(df: DataFrame, date_field: str, metric_field: str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., date, value): the metric's sum of each day that occurs."""
    return df.select(*(col(b) for b in by), typed_day(df, date_field).alias("date"), num(metric_field).alias("_v")).where(F.col("date").isNotNull()).groupBy(*by, "date").agg(total(F.col("_v")).alias("value"))


@operator("anomaly_scan")
def anomaly_scan(
    df: DataFrame,
    date_field: str,
    metric_field: str,
    baseline_window_days: int = 56,
    minimum_relative_scale: float = 0.01,
    min_baseline_n: int = 14,
    warmup_days: int = 14,
    min_same_weekday: int = 2,
    baseline_fallback_rows: int = 28,
    min_points_for_weekday: int = 8,
    dimensions: Sequence[str] = (),
) -> Result:
    """Each day against a robust baseline of the days before it: the same weekday where there are enough, else the
    last rows. Days without enough history are excluded with the reason. ``dimensions`` scans many series at once,
    each in its own window partition."""
    need(df, date_field, metric_field, *dimensions)
    if min(min_baseline_n, warmup_days, min_same_weekday) < 0:
        raise InputError("gates cannot be negative")
    s = daily(df, date_field, metric_field, dimensions)
    series = Window.partitionBy(*dimensions).orderBy("date")
    span = F.expr(f"collect_list(struct(date, value)) over ({'partition by ' + ', '.join(f'`{d}`' for d in dimensions) if dimensions else ''} order by date range between interval {int(baseline_window_days)} days preceding and interval 1 day preceding)")
    h = s.withColumn("_h", F.array_sort(span)).withColumn("_at", F.row_number().over(series) - 1)
    same = F.filter("_h", lambda x: F.weekday(x["date"]) == F.weekday(F.col("date")))
    enough = max(min_same_weekday, min_points_for_weekday)
    last = F.slice("_h", F.greatest(F.size("_h") - (baseline_fallback_rows - 1), F.lit(1)), baseline_fallback_rows)
    h = h.withColumn("baseline", F.when(F.size(same) >= enough, "same_weekday").otherwise("rolling")).withColumn("_b", F.transform(F.when(F.size(same) >= enough, same).otherwise(last), lambda x: x["value"])).withColumn("history_n", F.size("_h")).drop("_h")
    h = h.withColumn("n", F.size("_b")).withColumn("median", array_median(F.col("_b"))).withColumn("mean", array_mean(F.col("_b")))
    h = h.withColumn("mad", array_median(F.transform("_b", lambda x: F.abs(x - F.col("median"))))).withColumn("std", array_std(F.col("_b"), F.col("mean"))).drop("_b")
    scale = F.greatest(F.col("mad"), F.coalesce(F.col("std"), F.lit(0.0)) / 3, F.abs("median") * minimum_relative_scale, F.lit(1e-12))
    reason = F.when(F.col("_at") < warmup_days, "warmup_period").when(F.col("history_n") < min_baseline_n, "insufficient_baseline").when(F.col("n") < 3, "insufficient_baseline_points")
    rows = h.withColumn("delta", F.col("value") - F.col("median")).withColumn("scale", scale).withColumn("robust_z", F.col("delta") / (F.col("scale") * 1.4826)).withColumn("relative", div(F.col("delta"), F.col("median"))).withColumn("excluded", reason).drop("_at")
    judged = rows.where(F.col("excluded").isNull()).drop("excluded")
    coverage = rows.groupBy(F.coalesce("excluded", F.lit("judged")).alias("status")).agg(F.count(F.lit(1)).alias("days"))
    few = rows.agg(F.sum(F.when(F.col("excluded").isNull(), 1).otherwise(0)).alias("n"))
    notes = limitations(df, "anomaly_scan", [("BASELINE_CONTAMINATION", "earlier anomalies are part of later baselines"), ("NO_MULTIPLICITY_CORRECTION", "every day is judged by itself")], [(few, (F.col("n") > 0) & (F.col("n") < 14), "FEW_JUDGED_DAYS", "fewer than 14 days are judged"), (few, F.coalesce(F.col("n"), F.lit(0)) == 0, "ALL_EXCLUDED", "no day has enough history")])
    return Result({"rows": judged, "excluded": rows.where(F.col("excluded").isNotNull()), "coverage": coverage}, notes)
