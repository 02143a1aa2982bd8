"""Attribution, cohort retention, survival, path analysis, RFM and price elasticity."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.config import InputError, Result, limitations, need
from quillon.functions.exprs import col, days_between, div, flag, num, typed_day, typed_stamp
from quillon.functions.stats import chi_square_p
from quillon.operators.base import every
from quillon.registry import operator
from quillon.runtime import stash

MODELS = ("first_touch", "last_touch", "linear", "time_decay", "position_based", "shapley_equal")


@operator("attribution")
def attribution(
    df: DataFrame,
    id_field: str,
    channel_field: str,
    timestamp_field: str,
    conversion_field: str | None = None,
    value_field: str | None = None,
    models: Sequence[str] = MODELS,
    half_life_days: float = 7.0,
    lookback_days: float | None = None,
    position_first_weight: float = 0.4,
    position_last_weight: float = 0.4,
    order_tiebreak: str | None = None,
) -> Result:
    """Credit of each channel under several models.

    An entity's touches are its rows up to its last conversion; rows at the same time are ordered by
    ``order_tiebreak`` (default: the channel). One shuffle by entity for the windows, one by channel for the sums.
    """
    need(df, id_field, channel_field, timestamp_field, *(f for f in (conversion_field, value_field, order_tiebreak) if f))
    if unknown := set(models) - set(MODELS):
        raise InputError(f"no models {sorted(unknown)}")
    if half_life_days <= 0 or position_first_weight + position_last_weight > 1:
        raise InputError("half life has to be above 0 and position weights sum to 1 at most")
    t = df.select(
        col(id_field).alias("id"),
        col(channel_field).cast("string").alias("channel"),
        typed_stamp(df, timestamp_field).alias("ts"),
        (flag(conversion_field) if conversion_field else F.lit(True)).alias("conv"),
        (F.coalesce(num(value_field), F.lit(0.0)) if value_field else F.lit(None).cast("double")).alias("v"),
        (col(order_tiebreak) if order_tiebreak else col(channel_field).cast("string")).alias("tie"),
    ).where(F.col("id").isNotNull() & F.col("channel").isNotNull() & F.col("ts").isNotNull())
    entity = Window.partitionBy("id")
    path = entity.orderBy("ts", "tie", "channel")
    t = t.withColumn("_rn", F.row_number().over(path))
    t = t.withColumn("_last", F.max(F.when(F.col("conv"), F.col("_rn"))).over(entity)).withColumn("_conv_ts", F.max(F.when(F.col("conv"), F.struct("_rn", "ts"))).over(entity)["ts"])
    t = t.where(F.col("_rn") <= F.col("_last"))
    if lookback_days is not None:
        inside = F.unix_micros("ts") >= F.unix_micros("_conv_ts") - F.lit(int(lookback_days * 86_400_000_000))
        t = t.withColumn("_cut", F.max(F.when(~inside, 1).otherwise(0)).over(entity)).where(inside)
    else:
        t = t.withColumn("_cut", F.lit(0))
    t = t.withColumn("_i", F.row_number().over(path)).withColumn("_n", F.count(F.lit(1)).over(entity))
    age = days_between(F.col("_conv_ts"), F.col("ts"))
    t = t.withColumn("_decay", F.pow(F.lit(0.5), age / F.lit(float(half_life_days)))).withColumn("_value", F.sum("v").over(entity) if value_field else F.lit(1.0))
    t = t.withColumn("_decays", F.sum("_decay").over(entity)).withColumn("_of_channel", F.count(F.lit(1)).over(Window.partitionBy("id", "channel"))).withColumn("_first_of", F.row_number().over(Window.partitionBy("id", "channel").orderBy("_i")) == 1)
    t = t.withColumn("_channels", F.sum(F.col("_first_of").cast("int")).over(entity))
    i, n, one = F.col("_i"), F.col("_n"), F.lit(1.0)
    a, b = F.lit(float(position_first_weight)), F.lit(float(position_last_weight))
    middle = 1 - a - b
    weights = {
        "first_touch": F.when(i == 1, 1.0).otherwise(0.0),
        "last_touch": F.when(i == n, 1.0).otherwise(0.0),
        "linear": one / n,
        "time_decay": F.col("_decay") / F.col("_decays"),
        "position_based": F.when(n == 1, 1.0).when(n == 2, F.when(i == 1, a + middle / 2).otherwise(b + middle / 2)).when(i == 1, a).when(i == n, b).otherwise(middle / (n - 2)),
        "shapley_equal": F.when(F.col("_first_of"), one / F.col("_channels")).otherwise(0.0),
    }
    credited = t.select("id", "channel", "_i", "_n", "_value", "_cut", "_channels", *((weights[m] * F.col("_value")).alias(m) for m in models))
    rows = credited.groupBy("channel").agg(*(F.sum(m).alias(m) for m in models))
    most, least = (F.greatest(*models), F.least(*models)) if len(models) > 1 else (F.col(models[0]),) * 2
    totals = credited.agg(*(F.sum(m).alias(m) for m in models), F.sum(F.when(F.col("_i") == 1, F.col("_value"))).alias("_total"))
    rows = rows.withColumn("model_spread", most - least).withColumn("model_disagreement", div(F.col("model_spread"), F.sum(models[0]).over(every())))
    checks = totals.select(F.explode(F.array(*(F.struct(F.lit(m).alias("model"), F.col(m).alias("credited"), F.col("_total").alias("total"), (F.abs(F.col(m) - F.col("_total")) <= F.greatest(F.abs("_total"), F.lit(1.0)) * 1e-9).alias("matches")) for m in models))).alias("r")).select("r.*")
    heads = credited.where(F.col("_i") == 1)
    summary = heads.agg(F.count(F.lit(1)).alias("converted_entities"), F.avg((F.col("_channels") == 1).cast("double")).alias("single_channel_share"), F.percentile("_n", F.lit(0.5)).alias("median_path_length"), F.max("_n").alias("max_path_length"), F.coalesce(F.sum("_cut"), F.lit(0)).alias("truncated_paths"))
    notes = [("ATTR_NOT_INCREMENTAL", "credit is a rule, not an increment")] + [("ATTR_NO_LOOKBACK", "touches of any age count")] * (lookback_days is None)
    return Result({"rows": rows, "reconciliation": checks, "summary": summary}, limitations(df, "attribution", notes, [(summary, F.col("truncated_paths") > 0, "ATTR_TRUNCATED", "the lookback cuts off earlier touches"), (summary, F.col("single_channel_share") > 0.6, "ATTR_MOSTLY_SINGLE_CHANNEL", "most paths have one channel: models can hardly differ"), (summary, F.col("converted_entities") == 0, "ATTR_NO_CONVERSION", "no path converts")]))


@operator("cohort_retention")
def cohort_retention(df: DataFrame, id_field: str, date_field: str, period: str = "week", max_periods: int = 12, min_cohort_size: int = 30, value_field: str | None = None, cohort_field: str | None = None) -> Result:
    """How many of each cohort come back after each number of periods, zero-filled as far as it can be observed."""
    need(df, id_field, date_field, *(f for f in (value_field, cohort_field) if f))
    if period not in ("day", "week", "month"):
        raise InputError("period has to be day, week or month")
    bucket = lambda c: F.to_date(F.date_trunc(period, c))
    e = df.select(col(id_field).alias("id"), bucket(typed_day(df, date_field)).alias("bucket"), (bucket(typed_day(df, cohort_field)) if cohort_field else F.lit(None).cast("date")).alias("_given"), (F.coalesce(num(value_field), F.lit(0.0)) if value_field else F.lit(0.0)).alias("v"))
    # one row for each entity and period before anything is windowed: what follows grows with entities, not with rows
    e = e.where(F.col("id").isNotNull() & F.col("bucket").isNotNull()).groupBy("id", "bucket", "_given").agg(F.sum("v").alias("v"))
    cohort = F.col("_given") if cohort_field else F.min("bucket").over(Window.partitionBy("id"))
    e = e.withColumn("cohort", cohort).where(F.col("cohort").isNotNull())
    steps = lambda later, earlier: F.months_between(later, earlier).cast("int") if period == "month" else F.floor(F.datediff(later, earlier) / (7 if period == "week" else 1)).cast("int")
    e = e.withColumn("offset", steps(F.col("bucket"), F.col("cohort"))).where((F.col("offset") >= 0) & (F.col("offset") <= max_periods))
    # one row for each entity and period, whether it is in the base, and the cohort's size, by (cohort, offset)
    per = e.groupBy("cohort", "id", "offset").agg(F.sum("v").alias("v"), F.max("bucket").alias("_b"))
    per = per.withColumn("_base", F.max((F.col("offset") == 0).cast("int")).over(Window.partitionBy("cohort", "id")))
    cells = per.groupBy("cohort", "offset").agg(F.sum("_base").alias("retained"), F.sum(F.when(F.col("_base") == 1, F.col("v")).otherwise(0.0)).alias("value"), F.max("_b").alias("_b"))
    cells = cells.withColumn("_end", F.max("_b").over(every()))
    # a cohort's cells are at most max_periods + 1; they meet in one row, which is filled up to what can be observed
    heads = cells.groupBy("cohort").agg(F.max(F.when(F.col("offset") == 0, F.col("retained"))).alias("size"), F.max("_end").alias("_end"), F.map_from_entries(F.collect_list(F.struct("offset", F.struct("retained", "value")))).alias("_cells"))
    heads = heads.where(F.col("size") > 0).withColumn("elapsed", steps(F.col("_end"), F.col("cohort")))
    grid = heads.withColumn("offset", F.explode(F.sequence(F.lit(0), F.least(F.col("elapsed"), F.lit(max_periods)))))
    cell = F.try_element_at("_cells", F.col("offset"))
    rows = grid.withColumn("retained", F.coalesce(cell["retained"], F.lit(0))).withColumn("value", F.coalesce(cell["value"], F.lit(0.0)))
    rows = rows.select("cohort", "offset", "size", "retained", div(F.col("retained").cast("double"), F.col("size").cast("double")).alias("rate"), "value", div(F.col("value"), F.col("size").cast("double")).alias("value_per_entity"), (F.col("elapsed") > max_periods).alias("mature"), (F.col("size") < min_cohort_size).alias("below_min_size"))
    average = rows.where(F.col("mature") & ~F.col("below_min_size")).groupBy("offset").agg(F.avg("rate").alias("mean_rate"), F.percentile("rate", F.lit(0.5)).alias("median_rate"), F.count(F.lit(1)).alias("cohorts"))
    return Result({"rows": rows, "average": average}, limitations(df, "cohort_retention", [("COHORT_LEFT_TRUNCATED", "entities active before the data begin look new")], [(rows, ~F.col("mature"), "COHORT_IMMATURE", "some cohorts are not observed to the end"), (rows, F.col("below_min_size"), "COHORT_SMALL", "some cohorts are small")]))


@operator("survival")
def survival(df: DataFrame, duration_field: str, event_field: str | None = None, group_field: str | None = None, survival_at_times: Sequence[float] = ()) -> Result:
    """Kaplan-Meier curves of groups, and the log-rank test where there are two.

    The test covers the two groups' rows only.
    """
    need(df, duration_field, *(f for f in (event_field, group_field) if f))
    t = df.select((col(group_field).cast("string") if group_field else F.lit("all")).alias("group"), num(duration_field).alias("time"), (flag(event_field) if event_field else F.lit(True)).alias("event"))
    # counts by time first: windows then run over distinct times
    per = t.where((F.col("time") >= 0) & F.col("group").isNotNull()).groupBy("group", "time").agg(F.count(F.lit(1)).alias("c"), F.sum(F.col("event").cast("int")).alias("events"))
    per = per.withColumn("_rows", F.sum("c").over(Window.partitionBy("group"))).where(F.col("_rows") >= (2 if group_field else 1))
    table = per.withColumn("at_risk", F.sum("c").over(Window.partitionBy("group").orderBy(F.col("time").desc()))).where(F.col("events") > 0)
    run = Window.partitionBy("group").orderBy("time")
    d, r = F.col("events").cast("double"), F.col("at_risk").cast("double")
    alive = F.min(r - d).over(run)
    s = F.when(alive <= 0, 0.0).otherwise(F.exp(F.sum(F.ln(F.when(r > d, 1 - d / r).otherwise(1.0))).over(run)))
    g = F.sum(F.when(r > d, d / (r * (r - d))).otherwise(0.0)).over(run)
    curve = table.select("group", "time", F.col("at_risk").cast("bigint").alias("at_risk"), F.col("events").cast("bigint").alias("events"), (d / r).alias("hazard"), s.alias("survival"), g.alias("_g"))
    se = F.col("survival") * F.sqrt("_g")
    curve = curve.withColumn("se", se).withColumn("ci_low", F.greatest(F.col("survival") - 1.96 * se, F.lit(0.0))).withColumn("ci_high", F.least(F.col("survival") + 1.96 * se, F.lit(1.0))).drop("_g")
    sizes = per.groupBy("group").agg(F.sum("c").alias("n"), F.sum("events").cast("bigint").alias("events")).withColumn("censored", F.col("n") - F.col("events"))
    marks = curve.groupBy("group").agg(F.min(F.when(F.col("survival") <= 0.5, F.col("time"))).alias("median"), F.max(F.struct("hazard", (-F.col("time")).alias("_t"))).alias("_h"))
    summary = sizes.join(marks, "group", "left").select("group", "n", "events", "censored", "median", (-F.col("_h._t")).alias("highest_hazard_time"), F.col("_h.hazard").alias("highest_hazard"))
    tables = {"curve": curve, "summary": summary}
    if survival_at_times:
        at = [F.struct(F.lit(float(x)).alias("at_time"), F.coalesce(F.min(F.when(F.col("time") <= float(x), F.col("survival"))), F.lit(1.0)).alias("survival")) for x in survival_at_times]
        tables["at_times"] = sizes.select("group").join(curve, "group", "left").groupBy("group").agg(F.array(*at).alias("_a")).select("group", F.explode("_a").alias("a")).select("group", "a.*")
    if group_field:
        names = per.agg(F.min("group").alias("g1"), F.max("group").alias("g2"), F.count_distinct("group").alias("groups"))
        # both groups' counts at each time of either, then at-risk numbers from the end
        first = F.min("group").over(every())
        both = per.withColumn("_one", F.col("group") == first).groupBy("time").agg(F.sum("events").alias("d"), F.sum("c").alias("c"), F.sum(F.when(F.col("_one"), F.col("events")).otherwise(0)).alias("d1"), F.sum(F.when(F.col("_one"), F.col("c")).otherwise(0)).alias("c1"))
        back = Window.partitionBy().orderBy(F.col("time").desc())
        both = both.withColumn("n", F.sum("c").over(back).cast("double")).withColumn("n1", F.sum("c1").over(back).cast("double")).where(F.col("d") > 0)
        e1 = F.col("d") * F.col("n1") / F.col("n")
        v = F.when(F.col("n") > 1, F.col("d") * (F.col("n1") / F.col("n")) * (1 - F.col("n1") / F.col("n")) * (F.col("n") - F.col("d")) / (F.col("n") - 1)).otherwise(0.0)
        test = both.agg(F.sum("d1").cast("double").alias("observed"), F.sum(e1).alias("expected"), F.sum(v).alias("variance")).join(names, F.lit(True)).where(F.col("groups") == 2)
        chi = div(F.pow(F.col("observed") - F.col("expected"), F.lit(2.0)), F.col("variance"))
        tables["log_rank"] = test.select("g1", "g2", "observed", "expected", "variance", chi.alias("chi_square"), chi_square_p(chi, F.lit(1)).alias("p_value"))
    seen = sizes.agg(F.sum("censored").alias("c"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("g"))
    return Result(tables, limitations(df, "survival", [], [(seen, F.col("c") == 0, "SURV_ALL_EVENTS", "no row is censored"), (seen, F.col("c") > 0.7 * F.col("n"), "SURV_HEAVY_CENSORING", "over 70 % of rows are censored"), (seen, F.col("g") > 2, "SURV_GT2_GROUPS", "the log-rank test is for two groups")]))


@operator("path_analysis")
def path_analysis(df: DataFrame, id_field: str, step_field: str, timestamp_field: str, max_steps: int = 10, top_paths: int = 20, top_transitions: int = 50, terminal_steps: Sequence[str] = (), session_gap_minutes: float | None = None, order_tiebreak: str | None = None) -> Result:
    """Entries, exits, transitions and whole paths of entities or of their sessions.

    Rows beyond ``max_steps`` of a sequence are cut before anything is gathered, so an entity with very many events
    adds a bounded path; rows at the same time are ordered by ``order_tiebreak`` (default: the step).
    """
    need(df, id_field, step_field, timestamp_field, *([order_tiebreak] if order_tiebreak else []))
    t = df.select(col(id_field).alias("id"), col(step_field).cast("string").alias("step"), typed_stamp(df, timestamp_field).alias("ts"), (col(order_tiebreak) if order_tiebreak else col(step_field).cast("string")).alias("tie"))
    t = t.where(F.col("id").isNotNull() & F.col("step").isNotNull() & F.col("ts").isNotNull())
    path = Window.partitionBy("id").orderBy("ts", "tie", "step")
    if session_gap_minutes is None:
        t = t.withColumn("session", F.lit(0).cast("bigint"))
    else:
        gap = F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(path)) > F.lit(int(session_gap_minutes * 60_000_000))
        t = t.withColumn("session", F.sum(F.when(gap, 1).otherwise(0)).over(path.rowsBetween(Window.unboundedPreceding, 0)))
    # windows keep the partitioning by entity, so sessions need no further shuffle
    seq = Window.partitionBy("id", "session").orderBy("ts", "tie", "step")
    t = t.withColumn("_i", F.row_number().over(seq)).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("id", "session"))).where(F.col("_i") <= max_steps)
    t = t.withColumn("_next", F.lead("step").over(seq))
    pairs = t.where(F.col("_next").isNotNull()).groupBy(F.col("step").alias("from_step"), F.col("_next").alias("to_step")).agg(F.count(F.lit(1)).alias("count"))
    pairs = pairs.withColumn("share_of_outgoing", F.col("count") / F.sum("count").over(Window.partitionBy("from_step"))).withColumn("self_loop", F.col("from_step") == F.col("to_step"))
    whole = t.groupBy("id", "session").agg(F.array_sort(F.collect_list(F.struct("_i", "step"))).alias("_p"), F.max("_n").alias("_n"))
    whole = whole.select("id", "session", F.transform("_p", lambda x: x["step"]).alias("steps"), "_n").withColumn("entry", F.element_at("steps", 1)).withColumn("exit", F.element_at("steps", -1))
    ends = F.col("exit").isin(*terminal_steps) if terminal_steps else F.lit(None).cast("boolean")
    whole = whole.withColumn("_ends", ends)
    paths = whole.groupBy(F.array_join("steps", " > ").alias("path")).agg(F.count(F.lit(1)).alias("count"), F.max("_ends").alias("ends_at_terminal"))
    paths = paths.withColumn("share", F.col("count") / F.sum("count").over(every()))
    edges = whole.select(F.explode(F.array(F.struct(F.lit("entry").alias("kind"), F.col("entry").alias("step")), F.struct(F.lit("exit").alias("kind"), F.col("exit").alias("step")))).alias("e")).groupBy("e.kind", "e.step").agg(F.count(F.lit(1)).alias("count"))
    summary = whole.agg(F.count(F.lit(1)).alias("sequences"), F.avg(F.col("_ends").cast("double")).alias("terminal_reach_rate"), F.percentile(F.size("steps"), F.lit(0.5)).alias("median_length"), F.avg(F.size("steps")).alias("mean_length"), F.max(F.size("steps")).alias("max_length"), F.sum((F.col("_n") > max_steps).cast("int")).alias("truncated"))
    notes = [("PATH_NO_SESSION_GAP", "an entity's whole history is one path")] * (session_gap_minutes is None) + [("PATH_NO_TERMINAL", "no terminal steps are declared")] * (not terminal_steps)
    return Result(
        {"transitions": pairs.orderBy(F.col("count").desc(), "from_step", "to_step").limit(top_transitions), "paths": paths.orderBy(F.col("count").desc(), "path").limit(top_paths), "ends": edges, "summary": summary, "sequences": whole.drop("_n", "_ends")},
        limitations(df, "path_analysis", notes, [(summary, F.col("truncated") > 0, "PATH_TRUNCATED", "some sequences are longer than max_steps")]),
    )


def global_ranks(df: DataFrame, orders: Mapping[str, Sequence[str]]) -> DataFrame:
    """``df`` with its row numbers in some total orders, and its number of rows in ``_entities``.

    Rows are dealt into ranges of the whole order, ties split by its later columns, and sorted within a range; a row's
    number is its place there and the rows of the ranges before. Each order is written to shared storage, so places
    cannot change under a retry; no task sees more than a range, and what is broadcast is a row a range.
    """
    out = stash(df)
    names = df.columns
    for name, columns in orders.items():
        placed = stash(out.repartitionByRange(*columns).sortWithinPartitions(*columns).withColumn("_m", F.monotonically_increasing_id()))
        placed = placed.withColumn("_range", F.shiftright("_m", 33))
        counts = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_c"))
        before = counts.select(F.col("_range").alias("_r"), F.coalesce(F.sum("_c").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_c").over(every()).alias("_entities"))
        local = F.col("_m") - F.shiftleft(F.col("_range"), 33) + 1
        joined = placed.drop("_entities").join(F.broadcast(before), F.col("_range") == F.col("_r"))
        out = joined.select(*names, (F.col("_before") + local).alias(name), "_entities")
        names = [*names, name]
    return out


@operator("rfm")
def rfm(df: DataFrame, id_field: str, date_field: str, value_field: str, bins: int = 5, reference_date: Any = None, min_segment_size: int = 30, score_orientation: str = "documented") -> Result:
    """Recency, frequency and money scores of entities, and segments of them.

    A high score is good: recent, often, much. ``score_orientation="reference"`` turns the scores round. Ties are
    ordered by id. Ranks are computed range by range, so no task sees all entities; this runs when the operator is called.
    """
    need(df, id_field, date_field, value_field)
    if bins < 2 or score_orientation not in ("documented", "reference"):
        raise InputError("bins have to be 2 or more, score_orientation documented or reference")
    e = df.select(col(id_field).alias("id"), typed_day(df, date_field).alias("d"), num(value_field).alias("v")).where(F.col("id").isNotNull() & F.col("d").isNotNull() & F.col("v").isNotNull())
    per = e.groupBy("id").agg(F.max("d").alias("last_seen"), F.count(F.lit(1)).alias("frequency"), F.sum("v").alias("monetary"), F.min("d").alias("_first"))
    reference = F.lit(reference_date).cast("date") if reference_date is not None else F.max("last_seen").over(every())
    per = per.withColumn("recency", F.datediff(reference, F.col("last_seen")))
    n = F.col("_entities")
    turn = -1 if score_orientation == "reference" else 1
    keys = {"r_rank": F.col("recency") * -turn, "f_rank": F.col("frequency") * turn, "m_rank": F.col("monetary") * turn}
    keyed = per.select("*", *(k.alias(f"_k_{name}") for name, k in keys.items()))
    per = global_ranks(keyed, {name: (f"_k_{name}", "id") for name in keys})
    score = lambda rank: F.least(F.greatest(F.ceil((F.col(rank) / n) * bins), F.lit(1)), F.lit(bins)).cast("int")
    high, low = 0.6 * bins, 0.4 * bins
    per = per.withColumn("r", score("r_rank")).withColumn("f", score("f_rank")).withColumn("m", score("m_rank"))
    r, f, m = F.col("r"), F.col("f"), F.col("m")
    label = F.when((r >= high) & (f >= high) & (m >= high), "high_value_active").when((r >= high) & (f < low), "new_or_low_frequency").when((r < low) & (f >= high) & (m >= high), "at_risk_high_value").when((r < low) & (f < low), "dormant").when(m >= high, "high_spend_moderate_activity").otherwise("mid_tier")
    scored = per.select("id", "recency", "frequency", "monetary", "r", "f", "m", label.alias("segment"))
    segments = scored.groupBy("segment").agg(F.count(F.lit(1)).alias("size"), F.percentile("recency", F.lit(0.5)).alias("median_recency"), F.percentile("frequency", F.lit(0.5)).alias("median_frequency"), F.percentile("monetary", F.lit(0.5)).alias("median_monetary"), F.avg("monetary").alias("mean_monetary"), F.sum("monetary").alias("_m"))
    segments = segments.withColumn("share", F.col("size") / F.sum("size").over(every())).withColumn("monetary_share", div(F.col("_m"), F.sum("_m").over(every()))).withColumn("below_min_sample", F.col("size") < min_segment_size).drop("_m")
    steps = F.array(*(F.lit(i / bins) for i in range(bins + 1)))
    cuts = scored.agg(*(F.percentile(c, steps).alias(c) for c in ("recency", "frequency", "monetary")))
    cutoffs = cuts.select(F.posexplode(F.arrays_zip("recency", "frequency", "monetary")).alias("cut", "x")).select("cut", F.col("x.recency").cast("double").alias("recency"), F.col("x.frequency").cast("double").alias("frequency"), F.col("x.monetary").cast("double").alias("monetary"))
    span = per.agg(F.datediff(F.max("last_seen"), F.min("_first")).alias("days"), F.count(F.lit(1)).alias("n"))
    return Result({"entities": scored, "segments": segments, "cutoffs": cutoffs}, limitations(df, "rfm", [("RFM_RELATIVE", "scores are ranks within these entities")], [(segments, F.col("below_min_sample"), "RFM_SMALL_SEGMENT", "some segments are small"), (span, F.col("days") < 90, "RFM_SHORT_SPAN", "under 90 days of data"), (span, F.col("n") < bins, "RFM_FEW_ENTITIES", "fewer entities than bins")]))


@operator("price_elasticity")
def price_elasticity(df: DataFrame, price_field: str, quantity_field: str, group_field: str | None = None, min_points: int = 10, identification: str | None = None, randomized_pricing: bool = False) -> Result:
    """Slope of log quantity on log price, over all rows and for each group; groups that do not allow it have an error code."""
    need(df, price_field, quantity_field, *([group_field] if group_field else []))
    t = df.select((col(group_field).cast("string") if group_field else F.lit(None).cast("string")).alias("group"), num(price_field).alias("p"), num(quantity_field).alias("q")).where((F.col("p") > 0) & (F.col("q") > 0))
    t = t.withColumn("x", F.ln("p")).withColumn("y", F.ln("q"))

    def fit(g) -> DataFrame:
        s = g.agg(F.count(F.lit(1)).alias("n"), F.regr_slope("y", "x").alias("elasticity"), F.regr_intercept("y", "x").alias("intercept"), F.regr_r2("y", "x").alias("r2"), F.regr_sxx("y", "x").alias("_sxx"), F.regr_syy("y", "x").alias("_syy"), F.regr_sxy("y", "x").alias("_sxy"), F.stddev_samp("x").alias("_sd"), F.stddev_samp("p").alias("_psd"), F.avg("p").alias("_pm"))
        rss = F.greatest(F.col("_syy") - div(F.col("_sxy") * F.col("_sxy"), F.col("_sxx")), F.lit(0.0))
        error = F.when(F.col("n") < min_points, "too_few_points").when(F.coalesce(F.col("_sd"), F.lit(0.0)) <= 1e-9, "no_price_variation")
        s = s.withColumn("error", error).withColumn("se", F.sqrt(div(div(rss, (F.col("n") - 2).cast("double")), F.col("_sxx")))).withColumn("price_cv", div(F.col("_psd"), F.col("_pm")))
        keep = lambda c: F.when(F.col("error").isNull(), c)
        b = F.col("elasticity")
        return s.select(*(["group"] if "group" in s.columns else []), "n", keep(b).alias("elasticity"), keep(F.col("intercept")).alias("intercept"), keep(F.col("se")).alias("se"), keep(b - 1.96 * F.col("se")).alias("ci_low"), keep(b + 1.96 * F.col("se")).alias("ci_high"), keep(F.col("r2")).alias("r2"), keep(F.when(b < -1, "elastic").when((b > -1) & (b < 0), "inelastic").otherwise("non_standard")).alias("demand_type"), keep(F.when(b < -1, "revenue_falls").when((b > -1) & (b < 0), "revenue_rises").otherwise("unclear")).alias("if_price_rises"), "price_cv", "error", F.lit("L2" if randomized_pricing else "L1").alias("max_claim_level"))

    overall = fit(t.groupBy())
    tables = {"summary": overall} | ({"groups": fit(t.groupBy("group"))} if group_field else {})
    return Result(tables, limitations(df, "price_elasticity", [] if randomized_pricing else [("PRICE_ENDOGENOUS", "prices that follow demand bias the slope")], [(overall, F.col("elasticity") > 0, "PRICE_POSITIVE_ELASTICITY", "quantity rises with price"), (overall, F.col("price_cv") < 0.05, "PRICE_LOW_VARIATION", "prices hardly vary")]))
