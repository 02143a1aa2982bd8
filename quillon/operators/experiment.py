"""Power and detectable effect, sample ratio, multiple testing, CUPED and change points."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.config import InputError, Result, limitations, need
from quillon.functions.exprs import array_mean, array_median, array_std, col, div, num
from quillon.functions.stats import chi_square_p, critical, normal_p, quantile
from quillon.operators.base import arm_moments, daily, every, welch
from quillon.registry import operator


def _session(df: DataFrame | SparkSession | None) -> SparkSession:
    return df.sparkSession if isinstance(df, DataFrame) else df or SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()


@operator("power_mde")
def power_mde(
    df: DataFrame | SparkSession | None = None,
    metric_type: str = "binary",
    alpha: float = 0.05,
    power: float = 0.8,
    ratio: float = 1.0,
    two_sided: bool = True,
    baseline_rate: float | None = None,
    baseline_mean: float | None = None,
    baseline_sd: float | None = None,
    mde_absolute: float | None = None,
    mde_relative: float | None = None,
    n_per_arm: float | None = None,
    daily_traffic_per_arm: float | None = None,
    power_curve_effects: Sequence[float] | None = None,
) -> Result:
    """Sample size for an effect, effect for a sample size, and a curve. Plain numbers on the driver.

    For a rate the search for the detectable effect ends at min(rate, 1 - rate); where that does not suffice, it is null.
    """
    if not (0 < alpha < 1 and 0 < power < 1 and ratio > 0):
        raise InputError("alpha and power have to be between 0 and 1, ratio above 0")
    if metric_type == "binary":
        if baseline_rate is None or not 0 < baseline_rate < 1:
            raise InputError("a binary metric needs a baseline rate between 0 and 1")
        base, most = baseline_rate, min(baseline_rate, 1 - baseline_rate)
    elif metric_type == "continuous":
        if baseline_mean is None or baseline_sd is None or baseline_sd <= 0:
            raise InputError("a continuous metric needs baseline_mean and baseline_sd above 0")
        base, most = baseline_mean, abs(baseline_mean) + 10 * baseline_sd
    else:
        raise InputError("metric_type has to be binary or continuous")
    z = quantile(1 - alpha / (2 if two_sided else 1)) + quantile(power)

    def needed(effect: float) -> float | None:
        """Rows in an arm for an effect; null where the rate would leave (0, 1)."""
        if effect == 0:
            return None
        if metric_type == "continuous":
            v = (baseline_sd**2, baseline_sd**2)
        else:
            other = base + effect
            if not 0 < other < 1:
                return None
            v = (base * (1 - base), other * (1 - other))
        return z * z * (v[0] + v[1] / ratio) / effect**2

    effect = mde_absolute if mde_absolute is not None else None if mde_relative is None else mde_relative * abs(base)
    size = needed(effect) if effect is not None else None
    if effect is None and n_per_arm is None:
        raise InputError("give mde_absolute, mde_relative or n_per_arm")
    detectable = None
    if n_per_arm is not None:
        if n_per_arm <= 0:
            raise InputError("n_per_arm has to be above 0")
        low, high = 1e-12, most * (1 - 1e-12) if metric_type == "binary" else most
        reach = needed(high)
        if reach is not None and reach <= n_per_arm:
            for _ in range(200):
                middle = (low + high) / 2
                need_here = needed(middle)
                low, high = (middle, high) if need_here is None or need_here > n_per_arm else (low, middle)
            detectable = high
    grid = power_curve_effects or [k * (effect if effect is not None else detectable or most / 2) for k in (0.5, 0.75, 1.0, 1.5, 2.0)]
    spark = _session(df)
    whole = lambda x: None if x is None else float(math.ceil(x))
    days = whole(size / daily_traffic_per_arm) if size is not None and daily_traffic_per_arm else None
    summary = spark.createDataFrame([(metric_type, float(alpha), float(power), float(base), effect, whole(size), whole(size * ratio) if size is not None else None, days, detectable)], "metric_type string, alpha double, power double, baseline double, effect double, n_control double, n_treatment double, days double, detectable_effect double")
    curve = spark.createDataFrame([(float(e), whole(needed(float(e)))) for e in grid], "effect double, n_per_arm double")
    return Result({"summary": summary, "curve": curve}, spark.createDataFrame([], "op string, code string, detail string"))


@operator("srm_check")
def srm_check(df: DataFrame, variant_field: str, unit_field: str | None = None, expected_ratio: Mapping[str, float] | None = None, alpha: float = 0.001, order_field: str | None = None) -> Result:
    """Whether the arms' sizes fit the intended split. A unit counts once, in its first variant (by ``order_field``, or
    the smallest name); units in several variants block. Listed variants without rows count as 0."""
    need(df, variant_field, *(f for f in (unit_field, order_field) if f))
    if not 0 < alpha < 1:
        raise InputError("alpha has to be between 0 and 1")
    t = df.select(col(variant_field).cast("string").alias("variant"), *([col(unit_field).alias("unit")] if unit_field else []), *([col(order_field).alias("_o")] if order_field else [])).where(F.col("variant").isNotNull())
    if unit_field:
        first = F.min(F.struct("_o", "variant"))["variant"] if order_field else F.min("variant")
        units = t.where(F.col("unit").isNotNull()).groupBy("unit").agg(first.alias("variant"), (F.min("variant") != F.max("variant")).alias("_cross"))
    else:
        units = t.withColumn("_cross", F.lit(False))
    counts = units.groupBy("variant").agg(F.count(F.lit(1)).alias("observed"), F.sum(F.col("_cross").cast("int")).cast("bigint").alias("_crossed"))
    if expected_ratio:
        if any(v <= 0 for v in expected_ratio.values()):
            raise InputError("expected ratios have to be above 0")
        share = sum(expected_ratio.values())
        wanted = df.sparkSession.createDataFrame([(str(k), v / share) for k, v in expected_ratio.items()], "variant string, _share double")
        # one row for each variant
        counts = wanted.join(counts, "variant", "full").na.fill(0, ["observed", "_crossed"])
    else:
        counts = counts.withColumn("_share", F.lit(1.0) / F.count(F.lit(1)).over(every()))
    counts = counts.withColumn("expected", F.col("_share") * F.sum("observed").over(every()))
    part = div(F.pow(F.col("observed") - F.col("expected"), F.lit(2.0)), F.col("expected"))
    rows = counts.select("variant", "observed", "expected", part.alias("chi_square_contribution"), "_crossed")
    s = rows.agg(F.sum("chi_square_contribution").alias("chi_square"), F.greatest(F.count(F.lit(1)) - 1, F.lit(1)).cast("int").alias("df"), F.coalesce(F.sum("_crossed"), F.lit(0)).alias("cross_assigned"), F.min("expected").alias("_least"), F.max(F.col("expected").isNull()).alias("_unlisted"))
    s = s.withColumn("p_value", chi_square_p(F.col("chi_square"), F.col("df")))
    verdict = F.when(F.col("_unlisted"), "unlisted_variant").when((F.col("p_value") >= alpha) & (F.col("cross_assigned") == 0), "pass").otherwise("block")
    s = s.withColumn("verdict", verdict)
    notes = [("SRM_EQUAL_SPLIT_ASSUMED", "no expected ratio was given")] * (not expected_ratio) + [("SRM_NO_UNIT", "rows are counted, not units")] * (not unit_field)
    return Result({"rows": rows.drop("_crossed"), "summary": s.drop("_least", "_unlisted")}, limitations(df, "srm_check", notes, [(s, F.col("_least") < 5, "SRM_LOW_EXPECTED", "an expected count is below 5"), (s, F.col("cross_assigned") > 0, "SRM_CROSS_ASSIGNED", "units are in several variants")]))


@operator("multiple_testing")
def multiple_testing(df: DataFrame | SparkSession | None, tests: DataFrame | Sequence[Mapping[str, Any]] | None = None, method: str = "bh", alpha: float = 0.05) -> Result:
    """p-values adjusted by Bonferroni, Holm and Benjamini-Hochberg; ``tests`` has label, p_value and prespecified."""
    if method not in ("bh", "holm", "bonferroni") or not 0 < alpha < 1:
        raise InputError("method has to be bh, holm or bonferroni, alpha between 0 and 1")
    spark = _session(df)
    if tests is None:
        if not isinstance(df, DataFrame):
            raise InputError("no tests are given")
        tests = df
    if not isinstance(tests, DataFrame):
        if not tests:
            raise InputError("no tests are given")
        for t in tests:
            if not isinstance(t.get("p_value"), (int, float)) or not 0 <= t["p_value"] <= 1:
                raise InputError("each test needs a p_value between 0 and 1")
        tests = spark.createDataFrame([(i, str(t.get("label", i)), float(t["p_value"]), bool(t.get("prespecified", False))) for i, t in enumerate(tests)], "position int, label string, p_value double, prespecified boolean")
    elif "position" not in tests.columns:
        tests = tests.withColumn("position", F.row_number().over(Window.orderBy("label")) - 1)
    m = F.count(F.lit(1)).over(every())
    up = Window.orderBy("p_value", "position")
    down = Window.orderBy(F.col("p_value").desc(), F.col("position").desc())
    t = tests.withColumn("_m", m).withColumn("_rank", F.row_number().over(up))
    t = t.withColumn("bonferroni", F.least(F.lit(1.0), F.col("p_value") * F.col("_m")))
    t = t.withColumn("holm", F.least(F.lit(1.0), F.max(F.col("p_value") * (F.col("_m") - F.col("_rank") + 1)).over(up)))
    t = t.withColumn("bh", F.least(F.lit(1.0), F.min(F.col("p_value") * F.col("_m") / F.col("_rank")).over(down)))
    t = t.withColumn("adjusted", F.col(method)).withColumn("significant", F.col(method) < alpha).withColumn("exploratory", F.col("significant") & ~F.coalesce(F.col("prespecified"), F.lit(False)))
    rows = t.drop("_m", "_rank")
    summary = rows.agg(F.count(F.lit(1)).alias("tests"), *(F.sum((F.col(k) < alpha).cast("int")).cast("bigint").alias(f"rejected_{k}") for k in ("bonferroni", "holm", "bh")), F.sum((F.col("p_value") < alpha).cast("int")).cast("bigint").alias("rejected_raw"))
    return Result({"rows": rows, "summary": summary}, limitations(rows, "multiple_testing", [("MT_BH_IS_FDR", "Benjamini-Hochberg bounds the share of false discoveries")] * (method == "bh"), [(rows, F.col("exploratory"), "MT_EXPLORATORY", "some significant tests were not planned")]))


@operator("cuped")
def cuped(df: DataFrame, variant_field: str, metric_field: str, covariate_field: str, control: str = "A", treatment: str = "B", confidence_level: float = 0.95) -> Result:
    """An effect adjusted by a covariate from before the experiment, in one aggregate.

    The adjusted metric is never made: its means and variances follow from each arm's moments.
    """
    need(df, variant_field, metric_field, covariate_field)
    zc = critical(confidence_level)
    arm = col(variant_field).cast("string")
    t = df.select(arm.alias("arm"), num(metric_field).alias("y"), num(covariate_field).alias("x")).where(F.col("arm").isin(str(control), str(treatment)) & F.col("y").isNotNull() & F.col("x").isNotNull())
    one = arm_moments(t.withColumn("w", F.lit(1.0)), F.col("arm"), {"y": F.col("y"), "x": F.col("x")}, (str(control), str(treatment)))
    both = t.agg(F.count(F.lit(1)).alias("n"), F.covar_samp("y", "x").alias("_c"), F.var_samp("x").alias("_vx"), F.var_samp("y").alias("_vy"), F.avg("x").alias("_mx"), *(F.covar_samp(F.when(F.col("arm") == a, F.col("y")), F.when(F.col("arm") == a, F.col("x"))).alias(f"_c_{k}") for k, a in (("c", str(control)), ("t", str(treatment)))))
    # two rows of one row each
    m = one.join(both, F.lit(True)).withColumn("theta", div(F.col("_c"), F.col("_vx"))).withColumn("correlation", div(F.col("_c"), F.sqrt(F.col("_vx") * F.col("_vy"))))
    theta = F.col("theta")
    for k in "ct":
        m = m.withColumn(f"n_a_{k}", F.col(f"n_y_{k}")).withColumn(f"mean_a_{k}", F.col(f"mean_y_{k}") - theta * (F.col(f"mean_x_{k}") - F.col("_mx")))
        m = m.withColumn(f"var_a_{k}", F.col(f"var_y_{k}") - 2 * theta * F.col(f"_c_{k}") + theta * theta * F.col(f"var_x_{k}"))
    rows = None
    for name, key in (("raw", "y"), ("adjusted", "a"), ("covariate_balance", "x")):
        r = m.select(F.lit(name).alias("estimate"), *welch(m, key, zc))
        rows = r if rows is None else rows.unionByName(r)
    error = F.when(F.col("n") < 4, "too_few_rows").when(F.coalesce(F.col("_vx"), F.lit(0.0)) <= 0, "constant_covariate").when((F.col("n_y_c") < 2) | (F.col("n_y_t") < 2), "small_arm")
    balance_z = div(F.col("mean_x_t") - F.col("mean_x_c"), F.sqrt(div(F.col("var_x_c"), F.col("n_x_c")) + div(F.col("var_x_t"), F.col("n_x_t"))))
    balance_p = normal_p(balance_z)
    reduction = 1 - div(F.col("_vy") - 2 * theta * F.col("_c") + theta * theta * F.col("_vx"), F.col("_vy"))
    summary = m.select("n", "theta", "correlation", reduction.alias("variance_reduction"), balance_p.alias("balance_p"), F.coalesce(balance_p >= 0.01, F.lit(True)).alias("balanced"), error.alias("error"))
    return Result({"rows": rows, "summary": summary}, limitations(df, "cuped", [], [(summary, ~F.col("balanced"), "CUPED_IMBALANCED", "the arms differ before the experiment"), (summary, F.abs("correlation") < 0.2, "CUPED_WEAK_CORR", "the covariate explains little")]))


@operator("changepoint_scan")
def changepoint_scan(df: DataFrame, date_field: str, metric_field: str, min_segment_days: int = 7, seasonality: str | None = "weekly", cusum_drift: float = 0.5, cusum_threshold: float = 5.0) -> Result:
    """The strongest level shift of a daily series, trends on its sides, and CUSUM alarms.

    Prefix sums of centred values score all splits in one pass over days; the CUSUM fold runs over the array of
    days. All of it works on one row a day.
    """
    need(df, date_field, metric_field)
    if min_segment_days < 2 or seasonality not in (None, "none", "weekly"):
        raise InputError("min_segment_days has to be 2 or more, seasonality weekly or none")
    s = daily(df, date_field, metric_field).withColumn("_days", F.count(F.lit(1)).over(every()))
    if seasonality == "weekly":
        by = s.groupBy(F.weekday("date").alias("_w")).agg(F.percentile("value", F.lit(0.5)).alias("_m"), F.count(F.lit(1)).alias("_c"))
        mid = s.agg(F.percentile("value", F.lit(0.5)).alias("_all"))
        # seven rows, and one
        by = by.join(mid, F.lit(True)).select("_w", F.when(F.col("_c") >= 2, F.col("_m") - F.col("_all")).otherwise(0.0).alias("_season"))
        s = s.withColumn("_w", F.weekday("date")).join(F.broadcast(by), "_w").withColumn("x", F.when(F.col("_days") >= 14, F.col("value") - F.col("_season")).otherwise(F.col("value")))
    else:
        s = s.withColumn("x", F.col("value"))
    s = s.select("date", "value", "x", "_days")
    order = Window.orderBy("date")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    c = s.withColumn("_y", F.col("x") - F.avg("x").over(every())).withColumn("i", F.row_number().over(order) - 1)
    n, k = F.col("_days").cast("double"), F.col("i").cast("double")
    c = c.withColumn("_s", F.sum("_y").over(before)).withColumn("_q", F.sum(F.col("_y") * F.col("_y")).over(before)).withColumn("_all_s", F.sum("_y").over(every())).withColumn("_all_q", F.sum(F.col("_y") * F.col("_y")).over(every()))
    left_mean, right_mean = div(F.col("_s"), k), div(F.col("_all_s") - F.col("_s"), n - k)
    var = lambda q, total, m: F.greatest(div(q - div(total * total, m), m - 1), F.lit(0.0))
    se = F.sqrt(div(var(F.col("_q"), F.col("_s"), k), k) + div(var(F.col("_all_q") - F.col("_q"), F.col("_all_s") - F.col("_s"), n - k), n - k))
    splits = c.where((F.col("i") >= min_segment_days) & (F.col("i") <= F.col("_days") - min_segment_days))
    splits = splits.select("date", "i", "_days", (right_mean - left_mean).alias("shift"), se.alias("se"), F.avg("x").over(every()).alias("_ignored")).drop("_ignored").withColumn("t", div(F.abs("shift"), F.col("se")))
    best = splits.where(F.col("t").isNotNull()).orderBy(F.col("t").desc(), "date").limit(1)
    best = best.select(F.col("date").alias("break_date"), F.col("i").alias("split"), "shift", "se", "t", (F.col("shift") - 1.96 * F.col("se")).alias("ci_low"), (F.col("shift") + 1.96 * F.col("se")).alias("ci_high"), normal_p(F.col("t")).alias("p_value"))
    # slopes on the sides of the break: one row beside the days
    sides = c.select("i", "x").join(F.broadcast(best.select("split")), F.lit(True))
    trend = sides.agg(F.regr_slope(F.when(F.col("i") < F.col("split"), F.col("x")), F.col("i")).alias("slope_before"), F.regr_slope(F.when(F.col("i") >= F.col("split"), F.col("x")), F.col("i")).alias("slope_after"))
    trend = trend.withColumn("trend", F.when(F.abs("slope_after") > F.abs("slope_before"), "steeper").otherwise("flatter"))
    alarms = cusum(s.select("date", "x"), cusum_drift, cusum_threshold)
    seen = s.agg(F.count(F.lit(1)).alias("days"))
    notes = [("CP_SINGLE_BREAK", "one break is looked for"), ("CP_SELECTED_LOCATION", "the location was chosen by the data: p is too small")] + [("CP_NO_SEASONALITY", "no weekly pattern is removed")] * (seasonality != "weekly")
    return Result({"level_shift": best, "trend": trend, "cusum": alarms, "splits": splits.drop("_days")}, limitations(df, "changepoint_scan", notes, [(seen, F.col("days") < 2 * min_segment_days, "CP_TOO_SHORT", "fewer than two segments of days")]))


def cusum(series: DataFrame, drift: float = 0.5, threshold: float = 5.0) -> DataFrame:
    """(date, direction, value): alarms of the two-sided CUSUM of a (date, x) series; both sides start again at an alarm."""
    a = series.agg(F.array_sort(F.collect_list(F.struct("date", "x"))).alias("d"))
    xs = F.transform("d", lambda v: v["x"])
    a = a.withColumn("m", array_median(xs)).withColumn("mean", array_mean(xs))
    a = a.withColumn("mad", array_median(F.transform(xs, lambda v: F.abs(v - F.col("m"))))).withColumn("sd", array_std(xs, F.col("mean")))
    a = a.withColumn("scale", F.greatest(F.col("mad") * 1.4826, F.coalesce(F.col("sd"), F.lit(0.0)) / 3, F.lit(1e-12)))
    kind = "array<struct<date:date,direction:string,value:double>>"
    start = F.struct(F.lit(0.0).alias("up"), F.lit(0.0).alias("down"), F.array().cast(kind).alias("alarms"))

    def step(acc, v):
        z = (v["x"] - F.col("m")) / F.col("scale")
        up, down = F.greatest(F.lit(0.0), acc["up"] + z - drift), F.greatest(F.lit(0.0), acc["down"] - z - drift)
        hit = (up > threshold) | (down > threshold)
        alarm = F.struct(v["date"].alias("date"), F.when(up > threshold, "up").otherwise("down").alias("direction"), F.when(up > threshold, up).otherwise(down).alias("value"))
        return F.struct(F.when(hit, 0.0).otherwise(up).alias("up"), F.when(hit, 0.0).otherwise(down).alias("down"), F.when(hit, F.concat(acc["alarms"], F.array(alarm))).otherwise(acc["alarms"]).alias("alarms"))

    return a.select(F.explode(F.aggregate("d", start, step)["alarms"]).alias("a")).select("a.*")
