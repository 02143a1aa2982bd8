"""Queries over the test tables, one or more for each operator, and the same results in SQL."""

from __future__ import annotations

import csv
import io
import zipfile
from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions.text import direction, parse_money, statement_numbers

from quillon.operators.base import ab_effect, anomaly_scan, contribution, funnel_rates, ratio_decomp, segment_profile
from quillon.operators.experiment import changepoint_scan, cuped, multiple_testing, power_mde, srm_check
from quillon.operators.growth import attribution, cohort_retention, path_analysis, price_elasticity, rfm, survival
from quillon.plans.quality import Contract, date_gaps, profile_fields, profile_table, quality_gate
from quillon.plans.reconcile import reconcile
from quillon.plans.report import chart_rows, render
from quillon.plans.retail import regional_revenue, top_orders
from quillon.plans.verify import load_evidence, verify_claims
from quillon.runtime import scratch_dir, table, write_bytes
from quillon.sources.readers import load_frame, load_tables
from quillon.streaming.sessions import daily_sums, run_to_end

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def put(f: Callable[[SparkSession, str], DataFrame]):
        name = f.__name__.removesuffix("_query")
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def rounded(df: DataFrame, **digits: int) -> DataFrame:
    """Doubles rounded for comparison; others as they are."""
    return df.select(*(F.round(c, digits[c]).alias(c) if c in digits else F.col(c) for c in df.columns))


def r6(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns, doubles at six digits."""
    kinds = dict(df.dtypes)
    return df.select(*(F.round(c, 6).alias(c) if kinds[c] == "double" else F.col(c) for c in columns))


def _years(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").where(F.col("l_shipdate") >= F.lit("1996-01-01").cast("timestamp_ntz")).where(F.col("l_shipdate") < F.lit("1998-01-01").cast("timestamp_ntz")).select("l_returnflag", "l_extendedprice", (F.col("l_extendedprice") * F.col("l_discount")).alias("discounted"), F.year("l_shipdate").alias("year"))


_SIDES = {"current_filter": {"year": 1997}, "baseline_filter": {"year": 1996}}


@query("""
WITH s AS (SELECT l_returnflag AS "group", sum(CASE WHEN year(l_shipdate) = 1996 THEN l_extendedprice ELSE 0 END) AS b, sum(CASE WHEN year(l_shipdate) = 1997 THEN l_extendedprice ELSE 0 END) AS c
  FROM lineitem WHERE year(l_shipdate) IN (1996, 1997) GROUP BY 1)
SELECT printf('C-%03d', row_number() OVER (ORDER BY "group")) AS evidence_id, "group", round(b, 2) AS baseline, round(c, 2) AS current, round(c - b, 2) AS delta, round((c - b) / sum(c - b) OVER (), 6) AS share_of_gap FROM s
""")
def contribution_query(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(contribution(_years(spark, sf), "l_returnflag", "l_extendedprice", **_SIDES)["rows"], baseline=2, current=2, delta=2, share_of_gap=6)


_RATIO = """
WITH s AS (SELECT l_returnflag AS "group", sum(l_extendedprice * l_discount) FILTER (WHERE year(l_shipdate) = 1996) AS nb, sum(l_extendedprice) FILTER (WHERE year(l_shipdate) = 1996) AS db,
    sum(l_extendedprice * l_discount) FILTER (WHERE year(l_shipdate) = 1997) AS nc, sum(l_extendedprice) FILTER (WHERE year(l_shipdate) = 1997) AS dc
  FROM lineitem WHERE year(l_shipdate) IN (1996, 1997) GROUP BY 1),
r AS (SELECT "group", nb / nullif(db, 0) AS rb, nc / nullif(dc, 0) AS rc, coalesce(db, 0) / sum(db) OVER () AS wb, coalesce(dc, 0) / sum(dc) OVER () AS wc FROM s),
d AS (SELECT *, coalesce(wb * (rc - rb), 0) AS within, coalesce((wc - wb) * rb, 0) AS mix FROM r)
"""


@query(_RATIO + 'SELECT "group", round(rb, 8) AS rate_baseline, round(rc, 8) AS rate_current, round(wb, 8) AS weight_baseline, round(wc, 8) AS weight_current, round(within, 8) AS within, round(mix, 8) AS mix, round(within + mix, 8) AS contribution FROM d')
def ratio_decomp_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = ratio_decomp(_years(spark, sf), "l_returnflag", "discounted", "l_extendedprice", **_SIDES)["rows"]
    return rounded(rows, **dict.fromkeys(rows.columns[1:], 8))


@query(_RATIO + ", t AS (SELECT sum(nb) / sum(db) AS rate_baseline, sum(nc) / sum(dc) AS rate_current FROM s), p AS (SELECT sum(within) AS within_total, sum(mix) AS mix_total FROM d) SELECT round(rate_baseline, 8) AS rate_baseline, round(rate_current, 8) AS rate_current, round(within_total, 8) AS within_total, round(mix_total, 8) AS mix_total, round(rate_current - rate_baseline, 8) AS rate_delta, round(rate_current - rate_baseline - within_total - mix_total, 8) + 0.0 AS interaction_residual FROM t, p")
def ratio_decomp_summary(spark: SparkSession, sf: str) -> DataFrame:
    s = ratio_decomp(_years(spark, sf), "l_returnflag", "discounted", "l_extendedprice", **_SIDES)["summary"]
    return rounded(s, **dict.fromkeys(s.columns, 8)).withColumn("interaction_residual", F.col("interaction_residual") + 0.0)


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events")


@query("""
WITH c AS (SELECT sum((event_type = 'view')::INT)::DOUBLE AS a, sum((event_type = 'click')::INT)::DOUBLE AS b, sum((event_type = 'signup')::INT)::DOUBLE AS c, sum((event_type = 'purchase')::INT)::DOUBLE AS d FROM events)
SELECT 1 AS position, 'view' AS stage, a AS count, NULL::DOUBLE AS rate_from_previous, NULL::DOUBLE AS loss FROM c
UNION ALL SELECT 2, 'click', b, round(b / nullif(a, 0), 6), a - b FROM c
UNION ALL SELECT 3, 'signup', c, round(c / nullif(b, 0), 6), b - c FROM c
UNION ALL SELECT 4, 'purchase', d, round(d / nullif(c, 0), 6), c - d FROM c
""")
def funnel_rates_query(spark: SparkSession, sf: str) -> DataFrame:
    stages = ["view", "click", "signup", "purchase"]
    flags = _events(spark, sf).select(*((F.col("event_type") == s).cast("int").alias(s) for s in stages))
    return rounded(funnel_rates(flags, stages)["rows"], rate_from_previous=6)


@query("""
SELECT c_mktsegment AS segment, count(*) AS size, round(sum(c_acctbal), 2) AS balance, round(avg(c_acctbal), 4) AS mean_balance, count(c_name) AS named, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM customer GROUP BY 1
""")
def segment_profile_query(spark: SparkSession, sf: str) -> DataFrame:
    metrics = [{"field": "c_acctbal", "agg": "sum", "name": "balance"}, {"field": "c_acctbal", "agg": "mean", "name": "mean_balance"}, {"field": "c_name", "agg": "count", "name": "named"}]
    return rounded(segment_profile(table(spark, sf, "customer"), "c_mktsegment", metrics)["rows"], balance=2, mean_balance=4, share=6)


def _arms(spark: SparkSession, sf: str) -> DataFrame:
    return _events(spark, sf).withColumn("arm", F.when(F.col("user_id") % 2 == 0, "A").otherwise("B")).withColumn("bought", (F.col("event_type") == "purchase").cast("int"))


_ARMS = "SELECT *, CASE WHEN user_id % 2 = 0 THEN 'A' ELSE 'B' END AS arm, (event_type = 'purchase')::INT::DOUBLE AS bought FROM events"
_MOMENTS = "SELECT count(x) FILTER (WHERE arm = 'A')::DOUBLE AS nc, count(x) FILTER (WHERE arm = 'B')::DOUBLE AS nt, avg(x) FILTER (WHERE arm = 'A') AS mc, avg(x) FILTER (WHERE arm = 'B') AS mt, var_samp(x) FILTER (WHERE arm = 'A') AS vc, var_samp(x) FILTER (WHERE arm = 'B') AS vt FROM a"
_EFFECT = "SELECT nc AS control_n, nt AS treatment_n, round(mc, 6) AS control_mean, round(mt, 6) AS treatment_mean, round(mt - mc, 6) AS effect, round(se, 6) AS se, round((mt - mc) / se, 6) AS z, round(mt - mc - 1.959963984540054 * se, 6) AS ci_low, round(mt - mc + 1.959963984540054 * se, 6) AS ci_high, round((mt - mc) / mc, 6) AS relative_effect FROM e"


def _ab(df: DataFrame) -> DataFrame:
    return r6(df, "control_n", "treatment_n", "control_mean", "treatment_mean", "effect", "se", "z", "ci_low", "ci_high", "relative_effect")


@query(f"WITH a AS (SELECT arm, value AS x FROM ({_ARMS})), m AS ({_MOMENTS}), e AS (SELECT *, sqrt(vc / nc + vt / nt) AS se FROM m) {_EFFECT}")
def ab_effect_continuous(spark: SparkSession, sf: str) -> DataFrame:
    return _ab(ab_effect(_arms(spark, sf), "arm", "value", metric_type="continuous")["summary"])


@query(f"WITH a AS (SELECT arm, bought AS x FROM ({_ARMS})), m AS ({_MOMENTS}), e AS (SELECT *, sqrt((mc * nc + mt * nt) / (nc + nt) * (1 - (mc * nc + mt * nt) / (nc + nt)) * (1 / nc + 1 / nt)) AS se FROM m) {_EFFECT}")
def ab_effect_binary(spark: SparkSession, sf: str) -> DataFrame:
    return _ab(ab_effect(_arms(spark, sf), "arm", "bought")["summary"])


@query(f"WITH u AS (SELECT user_id, min(arm) AS variant FROM ({_ARMS}) GROUP BY 1), c AS (SELECT variant, count(*) AS observed FROM u GROUP BY 1), e AS (SELECT *, sum(observed) OVER () * 0.5::DOUBLE AS expected FROM c) SELECT variant, observed, expected, round((observed - expected) * (observed - expected) / expected, 6) AS chi_square_contribution FROM e")
def srm_check_rows(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(srm_check(_arms(spark, sf), "arm", unit_field="user_id", expected_ratio={"A": 1, "B": 1})["rows"], chi_square_contribution=6)


@query(f"WITH u AS (SELECT user_id, min(arm) AS variant FROM ({_ARMS}) GROUP BY 1), c AS (SELECT variant, count(*)::DOUBLE AS o, sum(count(*)) OVER () * 0.5::DOUBLE AS e FROM u GROUP BY 1) SELECT round(sum((o - e) * (o - e) / e), 6) AS chi_square, 1 AS df, 0::BIGINT AS cross_assigned, CASE WHEN sum((o - e) * (o - e) / e) <= 10.827566 THEN 'pass' ELSE 'block' END AS verdict FROM c")
def srm_check_summary(spark: SparkSession, sf: str) -> DataFrame:
    s = srm_check(_arms(spark, sf), "arm", unit_field="user_id", expected_ratio={"A": 1, "B": 1})["summary"]
    return rounded(s.select("chi_square", "df", "cross_assigned", "verdict"), chi_square=6)


def _pre_post(spark: SparkSession, sf: str) -> DataFrame:
    half = F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz")
    return _arms(spark, sf).groupBy("user_id", "arm").agg(F.sum(F.when(half, F.col("value")).otherwise(0.0)).alias("pre"), F.sum(F.when(half, 0.0).otherwise(F.col("value"))).alias("post"))


@query(f"""
WITH p AS (SELECT user_id, arm, sum(CASE WHEN ts < TIMESTAMP '2024-01-16' THEN value ELSE 0 END) AS x, sum(CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 0 ELSE value END) AS y FROM ({_ARMS}) GROUP BY 1, 2),
t AS (SELECT covar_samp(y, x) / var_samp(x) AS theta, avg(x) AS mx, corr(y, x) AS correlation FROM p),
j AS (SELECT arm, y, x, y - theta * (x - mx) AS a FROM p, t)
SELECT count(*) AS n, round(any_value(theta), 6) AS theta, round(any_value(correlation), 6) AS correlation, round(1 - var_samp(a) / var_samp(y), 6) AS variance_reduction FROM j, t
""")
def cuped_summary(spark: SparkSession, sf: str) -> DataFrame:
    return r6(cuped(_pre_post(spark, sf), "arm", "post", "pre")["summary"], "n", "theta", "correlation", "variance_reduction")


@query(f"""
WITH p AS (SELECT user_id, arm, sum(CASE WHEN ts < TIMESTAMP '2024-01-16' THEN value ELSE 0 END) AS x, sum(CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 0 ELSE value END) AS y FROM ({_ARMS}) GROUP BY 1, 2),
t AS (SELECT covar_samp(y, x) / var_samp(x) AS theta, avg(x) AS mx FROM p),
j AS (SELECT arm, 'raw' AS estimate, y AS v FROM p UNION ALL SELECT arm, 'adjusted', y - theta * (x - mx) FROM p, t UNION ALL SELECT arm, 'covariate_balance', x FROM p),
m AS (SELECT estimate, avg(v) FILTER (WHERE arm = 'B') - avg(v) FILTER (WHERE arm = 'A') AS effect, sqrt(var_samp(v) FILTER (WHERE arm = 'A') / count(*) FILTER (WHERE arm = 'A') + var_samp(v) FILTER (WHERE arm = 'B') / count(*) FILTER (WHERE arm = 'B')) AS se FROM j GROUP BY 1)
SELECT estimate, round(effect, 4) AS effect, round(se, 4) AS se, round(effect / se, 4) AS z FROM m
""")
def cuped_rows(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(cuped(_pre_post(spark, sf), "arm", "post", "pre")["rows"].select("estimate", "effect", "se", "z"), effect=4, se=4, z=4)


_TESTS = [{"label": "a", "p_value": 0.002, "prespecified": True}, {"label": "b", "p_value": 0.011}, {"label": "c", "p_value": 0.03}, {"label": "d", "p_value": 0.04}, {"label": "e", "p_value": 0.2}]


@query("""
WITH t AS (SELECT *, row_number() OVER (ORDER BY p_value, position) AS r, count(*) OVER () AS m FROM (VALUES (0, 'a', 0.002::DOUBLE, true), (1, 'b', 0.011::DOUBLE, false), (2, 'c', 0.03::DOUBLE, false), (3, 'd', 0.04::DOUBLE, false), (4, 'e', 0.2::DOUBLE, false)) v(position, label, p_value, prespecified)),
a AS (SELECT position, label, p_value, prespecified, least(1.0, p_value * m) AS bonferroni, least(1.0, max(p_value * (m - r + 1)) OVER (ORDER BY p_value, position)) AS holm, least(1.0, min(p_value * m / r) OVER (ORDER BY p_value DESC, position DESC)) AS bh FROM t)
SELECT position, label, p_value, prespecified, round(bonferroni, 9) AS bonferroni, round(holm, 9) AS holm, round(bh, 9) AS bh, round(bh, 9) AS adjusted, bh < 0.05 AS significant, bh < 0.05 AND NOT prespecified AS exploratory FROM a
""")
def multiple_testing_query(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(multiple_testing(spark, _TESTS)["rows"], bonferroni=9, holm=9, bh=9, adjusted=9)


@query("""
WITH t AS (SELECT l_linestatus AS "group", ln(l_extendedprice / l_quantity) AS x, ln(l_quantity) AS y FROM lineitem WHERE l_extendedprice > 0 AND l_quantity > 0),
s AS (SELECT "group", count(*) AS n, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, regr_r2(y, x) AS r2, sqrt((regr_syy(y, x) - regr_sxy(y, x) * regr_sxy(y, x) / regr_sxx(y, x)) / (count(*) - 2) / regr_sxx(y, x)) AS se FROM t GROUP BY 1)
SELECT "group", n, round(b, 6) AS elasticity, round(a, 6) AS intercept, round(se, 6) AS se, round(b - 1.96 * se, 6) AS ci_low, round(b + 1.96 * se, 6) AS ci_high, round(r2, 6) AS r2, CASE WHEN b < -1 THEN 'elastic' WHEN b > -1 AND b < 0 THEN 'inelastic' ELSE 'non_standard' END AS demand_type FROM s
""")
def price_elasticity_query(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "lineitem").select("l_linestatus", (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), "l_quantity")
    return r6(price_elasticity(t, "price", "l_quantity", "l_linestatus")["groups"], "group", "n", "elasticity", "intercept", "se", "ci_low", "ci_high", "r2", "demand_type")


_RFM = """
WITH p AS (SELECT o_custkey AS id, max(o_orderdate)::DATE AS last, count(*) AS frequency, sum(o_totalprice) AS monetary FROM orders GROUP BY 1),
q AS (SELECT *, date_diff('day', last, DATE '2001-08-01') AS recency, count(*) OVER ()::DOUBLE AS n FROM p),
k AS (SELECT *, ceil(row_number() OVER (ORDER BY -recency, id) / n * 5)::INT AS r, ceil(row_number() OVER (ORDER BY frequency, id) / n * 5)::INT AS f, ceil(row_number() OVER (ORDER BY monetary, id) / n * 5)::INT AS m FROM q),
g AS (SELECT *, CASE WHEN r >= 3 AND f >= 3 AND m >= 3 THEN 'high_value_active' WHEN r >= 3 AND f < 2 THEN 'new_or_low_frequency' WHEN r < 2 AND f >= 3 AND m >= 3 THEN 'at_risk_high_value' WHEN r < 2 AND f < 2 THEN 'dormant' WHEN m >= 3 THEN 'high_spend_moderate_activity' ELSE 'mid_tier' END AS segment FROM k)
"""


def _rfm(spark: SparkSession, sf: str):
    return rfm(table(spark, sf, "orders"), "o_custkey", "o_orderdate", "o_totalprice", reference_date="2001-08-01")


@query(_RFM + "SELECT id, recency::INT AS recency, frequency, round(monetary, 2) AS monetary, r, f, m, segment FROM g")
def rfm_entities(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_rfm(spark, sf)["entities"], monetary=2)


@query(_RFM + "SELECT segment, count(*) AS size, quantile_cont(recency, 0.5)::DOUBLE AS median_recency, quantile_cont(frequency, 0.5)::DOUBLE AS median_frequency, round(quantile_cont(monetary, 0.5), 2) AS median_monetary, round(avg(monetary), 2) AS mean_monetary, round(count(*) / sum(count(*)) OVER (), 6) AS share, round(sum(monetary) / sum(sum(monetary)) OVER (), 6) AS monetary_share, count(*) < 30 AS below_min_sample FROM g GROUP BY 1")
def rfm_segments(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_rfm(spark, sf)["segments"], median_monetary=2, mean_monetary=2, share=6, monetary_share=6)


@query("""
WITH e AS (SELECT o_custkey AS id, date_trunc('month', o_orderdate)::DATE AS b, o_totalprice AS v FROM orders),
c AS (SELECT *, min(b) OVER (PARTITION BY id) AS cohort FROM e),
o AS (SELECT *, date_diff('month', cohort, b) AS k FROM c WHERE date_diff('month', cohort, b) <= 12),
s AS (SELECT cohort, count(DISTINCT id) AS size FROM o WHERE k = 0 GROUP BY 1),
z AS (SELECT cohort, size, date_diff('month', cohort, (SELECT max(b) FROM o)) AS elapsed FROM s),
g AS (SELECT cohort, size, elapsed, unnest(range(0, least(elapsed, 12) + 1)) AS k FROM z),
x AS (SELECT cohort, k, count(DISTINCT id) AS retained, sum(v) AS value FROM o GROUP BY 1, 2)
SELECT cohort, g.k::INT AS "offset", size, coalesce(retained, 0) AS retained, round(coalesce(retained, 0) / size, 6) AS rate, round(coalesce(value, 0), 2) AS value, round(coalesce(value, 0) / size, 6) AS value_per_entity, elapsed > 12 AS mature, size < 30 AS below_min_size
FROM g LEFT JOIN x USING (cohort, k)
""")
def cohort_retention_query(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(cohort_retention(table(spark, sf, "orders"), "o_custkey", "o_orderdate", period="month", value_field="o_totalprice")["rows"], rate=6, value=2, value_per_entity=6)


def _durations(spark: SparkSession, sf: str) -> DataFrame:
    e = _events(spark, sf).groupBy("user_id").agg(F.min("ts").alias("a"), F.min(F.when((F.col("event_type") == "purchase") & (F.col("value") > 60), F.col("ts"))).alias("b"), F.max("ts").alias("z"))
    return e.select((F.col("user_id") % 2).cast("string").alias("arm"), F.datediff(F.coalesce("b", "z"), "a").cast("double").alias("days"), F.col("b").isNotNull().cast("int").alias("event"))


_SURVIVAL = """
WITH e AS (SELECT user_id, min(ts) AS a, min(ts) FILTER (WHERE event_type = 'purchase' AND value > 60) AS b, max(ts) AS z FROM events GROUP BY 1),
t AS (SELECT (user_id % 2)::VARCHAR AS "group", date_diff('day', a::DATE, coalesce(b, z)::DATE)::DOUBLE AS time, (b IS NOT NULL)::INT AS event FROM e),
p AS (SELECT "group", time, count(*) AS c, sum(event) AS events FROM t GROUP BY 1, 2)
"""


@query(_SURVIVAL + """, r AS (SELECT *, sum(c) OVER (PARTITION BY "group" ORDER BY time DESC) AS n FROM p),
k AS (SELECT "group", time, n, events, CASE WHEN min(n - events) OVER w = 0 THEN 0 ELSE exp(sum(CASE WHEN n > events THEN ln(1 - events / n) ELSE 0 END) OVER w) END AS s, sum(CASE WHEN n > events THEN events / (n::DOUBLE * (n - events)) ELSE 0 END) OVER w AS g FROM r WHERE events > 0 WINDOW w AS (PARTITION BY "group" ORDER BY time))
SELECT "group", time, n::BIGINT AS at_risk, events::BIGINT AS events, round(events / n, 6) AS hazard, round(s, 6) AS survival, round(s * sqrt(g), 6) AS se, round(greatest(s - 1.96 * s * sqrt(g), 0), 6) AS ci_low, round(least(s + 1.96 * s * sqrt(g), 1), 6) AS ci_high FROM k
""")
def survival_curve(spark: SparkSession, sf: str) -> DataFrame:
    return r6(survival(_durations(spark, sf), "days", "event", "arm")["curve"], "group", "time", "at_risk", "events", "hazard", "survival", "se", "ci_low", "ci_high")


@query(_SURVIVAL + """, b AS (SELECT time, sum(events) AS d, sum(c) AS c, sum(CASE WHEN "group" = '0' THEN events ELSE 0 END) AS d1, sum(CASE WHEN "group" = '0' THEN c ELSE 0 END) AS c1 FROM p GROUP BY 1),
k AS (SELECT *, (sum(c) OVER (ORDER BY time DESC))::DOUBLE AS n, (sum(c1) OVER (ORDER BY time DESC))::DOUBLE AS n1 FROM b),
s AS (SELECT sum(d1)::DOUBLE AS o, sum(d * n1 / n) AS e, sum(CASE WHEN n > 1 THEN d * (n1 / n) * (1 - n1 / n) * (n - d) / (n - 1) ELSE 0 END) AS v FROM k WHERE d > 0)
SELECT '0' AS g1, '1' AS g2, o AS observed, round(e, 6) AS expected, round(v, 6) AS variance, round((o - e) * (o - e) / v, 6) AS chi_square FROM s
""")
def survival_log_rank(spark: SparkSession, sf: str) -> DataFrame:
    return r6(survival(_durations(spark, sf), "days", "event", "arm")["log_rank"], "g1", "g2", "observed", "expected", "variance", "chi_square")


@query("""
WITH t AS (SELECT user_id AS id, event_type AS channel, ts, event_type = 'purchase' AS conv, coalesce(value, 0) AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
l AS (SELECT id, max(rn) AS last FROM t WHERE conv GROUP BY 1),
p AS (SELECT t.*, last, count(*) OVER e AS n, sum(v) OVER e AS value, max(CASE WHEN rn = last THEN ts END) OVER e AS cts FROM t JOIN l USING (id) WHERE rn <= last WINDOW e AS (PARTITION BY id)),
w AS (SELECT *, pow(0.5::DOUBLE, (epoch_us(cts) - epoch_us(ts)) / 86400000000.0::DOUBLE / 7.0::DOUBLE) AS decay, row_number() OVER (PARTITION BY id, channel ORDER BY rn) = 1 AS head FROM p),
c AS (SELECT *, decay / sum(decay) OVER (PARTITION BY id) AS td, sum(head::INT) OVER (PARTITION BY id) AS k FROM w),
s AS (SELECT channel, sum(CASE WHEN rn = 1 THEN value ELSE 0 END) AS first_touch, sum(CASE WHEN rn = n THEN value ELSE 0 END) AS last_touch, sum(value / n) AS linear, sum(td * value) AS time_decay,
  sum(value * CASE WHEN n = 1 THEN 1.0::DOUBLE WHEN n = 2 THEN 0.5::DOUBLE WHEN rn = 1 OR rn = n THEN 0.4::DOUBLE ELSE 0.2::DOUBLE / (n - 2) END) AS position_based, sum(CASE WHEN head THEN value / k ELSE 0 END) AS shapley_equal FROM c GROUP BY 1)
SELECT channel, round(first_touch, 3) AS first_touch, round(last_touch, 3) AS last_touch, round(linear, 3) AS linear, round(time_decay, 3) AS time_decay, round(position_based, 3) AS position_based, round(shapley_equal, 3) AS shapley_equal FROM s
""")
def attribution_query(spark: SparkSession, sf: str) -> DataFrame:
    e = _events(spark, sf).withColumn("bought", (F.col("event_type") == "purchase").cast("int"))
    rows = attribution(e, "user_id", "event_type", "ts", "bought", "value", order_tiebreak="event_id")["rows"].drop("model_spread", "model_disagreement")
    return rounded(rows, **dict.fromkeys(rows.columns[1:], 3))


_PATHS = """
WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) > 1800000000 THEN 1 ELSE 0 END AS cut FROM events),
s AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM g),
q AS (SELECT *, row_number() OVER (PARTITION BY user_id, session ORDER BY ts, event_id) AS i FROM s),
p AS (SELECT *, lead(event_type) OVER (PARTITION BY user_id, session ORDER BY ts, event_id) AS nxt FROM q WHERE i <= 10)
"""


def _paths(spark: SparkSession, sf: str):
    return path_analysis(_events(spark, sf), "user_id", "event_type", "ts", session_gap_minutes=30, terminal_steps=["purchase"], order_tiebreak="event_id")


@query(_PATHS + "SELECT event_type AS from_step, nxt AS to_step, count(*) AS count, round(count(*) / sum(count(*)) OVER (PARTITION BY event_type), 6) AS share_of_outgoing, event_type = nxt AS self_loop FROM p WHERE nxt IS NOT NULL GROUP BY 1, 2")
def path_transitions(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_paths(spark, sf)["transitions"], share_of_outgoing=6)


@query(_PATHS + ", w AS (SELECT user_id, session, string_agg(event_type, ' > ' ORDER BY i) AS path, arg_max(event_type, i) AS last FROM p GROUP BY 1, 2) SELECT path, count(*) AS count, max(last = 'purchase') AS ends_at_terminal, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM w GROUP BY 1 ORDER BY count DESC, path LIMIT 20")
def path_top_paths(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_paths(spark, sf)["paths"], share=6)


@query(_PATHS + ", w AS (SELECT user_id, session, count(*) AS n, arg_max(event_type, i) AS last FROM p GROUP BY 1, 2), z AS (SELECT user_id, session FROM q WHERE i = 11) SELECT count(*) AS sequences, round(avg((last = 'purchase')::INT), 6) AS terminal_reach_rate, quantile_cont(n, 0.5)::DOUBLE AS median_length, round(avg(n), 6) AS mean_length, max(n)::INT AS max_length, (SELECT count(*) FROM z) AS truncated FROM w")
def path_summary(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_paths(spark, sf)["summary"], terminal_reach_rate=6, mean_length=6)


@query("""
WITH s AS (SELECT o_orderdate::DATE AS date, sum(o_totalprice) AS value, row_number() OVER (ORDER BY o_orderdate::DATE) - 1 AS "at" FROM orders GROUP BY 1),
h AS (SELECT a.date, a.value, a."at", b.date AS d, b.value AS v, row_number() OVER (PARTITION BY a.date ORDER BY b.date DESC) AS back, count(*) OVER (PARTITION BY a.date) AS hn, sum((isodow(a.date) = isodow(b.date))::INT) OVER (PARTITION BY a.date) AS same, isodow(a.date) = isodow(b.date) AS is_same
  FROM s a JOIN s b ON b.date >= a.date - INTERVAL 56 DAY AND b.date < a.date),
u AS (SELECT date, any_value(value) AS value, any_value("at") AS pos, any_value(hn) AS hn, any_value(same) AS same, count(*) AS n, median(v) AS med, mad(v) AS mad, stddev_samp(v) AS sd FROM h WHERE CASE WHEN same >= 8 THEN is_same ELSE back <= 28 END GROUP BY date),
z AS (SELECT *, greatest(mad, coalesce(sd, 0) / 3, abs(med) * 0.01, 1e-12) AS scale FROM u WHERE pos >= 14 AND hn >= 14 AND n >= 3)
SELECT date, round(value, 2) AS value, CASE WHEN same >= 8 THEN 'same_weekday' ELSE 'rolling' END AS baseline, hn::INT AS history_n, n::INT AS n, round(med, 4) AS median, round((value - med) / (scale * 1.4826), 6) AS robust_z, round((value - med) / med, 6) AS relative FROM z
""")
def anomaly_scan_query(spark: SparkSession, sf: str) -> DataFrame:
    rows = anomaly_scan(table(spark, sf, "orders"), "o_orderdate", "o_totalprice")["rows"]
    return rounded(rows.select("date", "value", "baseline", "history_n", "n", "median", "robust_z", "relative"), value=2, median=4, robust_z=6, relative=6)


_SERIES = """
WITH s AS (SELECT o_orderdate::DATE AS date, sum(o_totalprice) AS value FROM orders GROUP BY 1),
m AS (SELECT isodow(date) AS w, CASE WHEN count(*) >= 2 THEN median(value) - (SELECT median(value) FROM s) ELSE 0 END AS season FROM s GROUP BY 1),
x AS (SELECT date, value - CASE WHEN (SELECT count(*) FROM s) >= 14 THEN season ELSE 0 END AS x FROM s JOIN m ON isodow(date) = w)
"""


@query(_SERIES + """, y AS (SELECT date, x - avg(x) OVER () AS y, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS n FROM x),
c AS (SELECT date, i, n, sum(y) OVER b AS s, sum(y * y) OVER b AS q, sum(y) OVER () AS ts, sum(y * y) OVER () AS tq FROM y WINDOW b AS (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT date, i, (ts - s) / (n - i) - s / i AS shift, sqrt((q - s * s / i) / (i - 1) / i + (tq - q - (ts - s) * (ts - s) / (n - i)) / (n - i - 1) / (n - i)) AS se FROM c WHERE i >= 7 AND i <= n - 7)
SELECT date AS break_date, i::INT AS split, round(shift, 2) AS shift, round(se, 2) AS se, round(abs(shift) / se, 4) AS t FROM t ORDER BY abs(shift) / se DESC, date LIMIT 1
""")
def changepoint_level_shift(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(changepoint_scan(table(spark, sf, "orders"), "o_orderdate", "o_totalprice")["level_shift"].select("break_date", "split", "shift", "se", "t"), shift=2, se=2, t=4)


@query("WITH RECURSIVE " + _SERIES.replace("WITH ", "", 1) + """, f AS (SELECT median(x) AS m, greatest(mad(x) * 1.4826, stddev_samp(x) / 3, 1e-12) AS scale FROM x),
o AS (SELECT date, (x - m) / scale AS z, row_number() OVER (ORDER BY date) AS i FROM x, f),
r(i, up, down, hit, a, b) AS (SELECT 0::BIGINT, 0.0::DOUBLE, 0.0::DOUBLE, false, 0.0::DOUBLE, 0.0::DOUBLE
  UNION ALL SELECT n.i, CASE WHEN n.a > 5 OR n.b > 5 THEN 0 ELSE n.a END, CASE WHEN n.a > 5 OR n.b > 5 THEN 0 ELSE n.b END, n.a > 5 OR n.b > 5, n.a, n.b
  FROM (SELECT o.i AS i, greatest(0, r.up + o.z - 0.5) AS a, greatest(0, r.down - o.z - 0.5) AS b FROM r JOIN o ON o.i = r.i + 1) n)
SELECT date, CASE WHEN a > 5 THEN 'up' ELSE 'down' END AS direction, round(CASE WHEN a > 5 THEN a ELSE b END, 6) AS value FROM r JOIN o USING (i) WHERE hit
""")
def changepoint_cusum(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(changepoint_scan(table(spark, sf, "orders"), "o_orderdate", "o_totalprice")["cusum"], value=6)


@query("""
WITH s AS (SELECT pow(1.959963984540054::DOUBLE + 0.8416212335729143::DOUBLE, 2) * (0.5 * 0.5 + 0.55 * 0.45) / pow(0.05::DOUBLE, 2) AS n)
SELECT 'binary' AS metric_type, 0.05::DOUBLE AS alpha, 0.8::DOUBLE AS power, 0.5::DOUBLE AS baseline, 0.05::DOUBLE AS effect, ceil(n) AS n_control, ceil(n) AS n_treatment, ceil(n / 500) AS days, NULL::DOUBLE AS detectable_effect FROM s
""")
def power_mde_query(spark: SparkSession, sf: str) -> DataFrame:
    return power_mde(spark, baseline_rate=0.5, mde_absolute=0.05, daily_traffic_per_arm=500)["summary"]


@query("""
WITH n AS (SELECT count(*) AS n FROM orders)
SELECT 'o_orderkey' AS field, count(*) FILTER (WHERE o_orderkey IS NULL) AS missing_count, count(DISTINCT o_orderkey) AS unique_count, true AS is_numeric, round(min(o_orderkey)::DOUBLE, 2) AS min, round(max(o_orderkey)::DOUBLE, 2) AS max, round(avg(o_orderkey), 2) AS mean, round(median(o_orderkey), 2) AS median FROM orders
UNION ALL SELECT 'o_totalprice', count(*) FILTER (WHERE o_totalprice IS NULL), count(DISTINCT o_totalprice), true, round(min(o_totalprice), 2), round(max(o_totalprice), 2), round(avg(o_totalprice), 2), round(median(o_totalprice), 4) FROM orders
UNION ALL SELECT 'o_orderpriority', count(*) FILTER (WHERE o_orderpriority IS NULL), count(DISTINCT o_orderpriority), false, NULL, NULL, NULL, NULL FROM orders
""")
def profile_fields_query(spark: SparkSession, sf: str) -> DataFrame:
    p = profile_fields(table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority"))
    return rounded(p.select("field", "missing_count", "unique_count", "is_numeric", "min", "max", "mean", "median"), min=2, max=2, mean=2, median=4)


@query("SELECT count(*) AS rows, (SELECT count(*) FROM orders) - count(*) AS duplicate_rows, min(o_orderdate)::DATE AS first_day, max(o_orderdate)::DATE AS last_day, count(DISTINCT o_orderdate::DATE) AS unique_days, 6 AS columns, greatest(0, date_diff('day', min(o_orderdate)::DATE, max(o_orderdate)::DATE) + 1 - count(DISTINCT o_orderdate::DATE)) AS missing_days FROM (SELECT DISTINCT * FROM orders)")
def profile_table_query(spark: SparkSession, sf: str) -> DataFrame:
    return profile_table(table(spark, sf, "orders"), "o_orderdate")


@query("SELECT d::DATE AS day FROM (SELECT unnest(generate_series(min(o_orderdate)::DATE, max(o_orderdate)::DATE, INTERVAL 1 DAY)) AS d FROM orders) WHERE d::DATE NOT IN (SELECT o_orderdate::DATE FROM orders)")
def date_gaps_query(spark: SparkSession, sf: str) -> DataFrame:
    return date_gaps(table(spark, sf, "orders"), "o_orderdate")


@query("""
WITH d AS (SELECT o_orderdate::DATE AS day, CASE WHEN sum(o_totalprice) > 0 THEN sum(o_totalprice) END AS v FROM orders GROUP BY 1),
s AS (SELECT median(v) AS med, stddev_samp(v) AS sd, mad(v) AS mad FROM d)
SELECT 'metric_outlier' AS "check", 'warning' AS severity, 'revenue' AS field, day, round((v - med) / (greatest(mad, sd / 3, 1e-12) * 1.4826), 6) AS value FROM d, s WHERE (v - med) / (greatest(mad, sd / 3, 1e-12) * 1.4826) > 3
UNION ALL SELECT 'date_gap', 'warning', 'day', x::DATE, NULL FROM (SELECT unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS x FROM d) WHERE x::DATE NOT IN (SELECT day FROM d)
""")
def quality_gate_query(spark: SparkSession, sf: str) -> DataFrame:
    days = table(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.sum("o_totalprice").alias("revenue"))
    flags = quality_gate(days, Contract.from_dict({"date_field": "day", "metric_fields": {"pay_success": "revenue"}, "quality": {"outlier_z": 3}}))["flags"]
    return rounded(flags.drop("detail"), value=6)


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN -l_extendedprice ELSE l_extendedprice END AS number, l_returnflag = 'A' AS is_percent FROM lineitem")
def money_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Prices written as a bookkeeper would, and read again."""
    text = F.format_number("l_extendedprice", 2)
    cell = F.when(F.col("l_returnflag") == "R", F.concat(F.lit("("), text, F.lit(")"))).when(F.col("l_returnflag") == "A", F.concat(text, F.lit("%"))).otherwise(F.concat(F.lit("¥ "), text))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", parse_money(cell).alias("m")).select("l_orderkey", "l_linenumber", "m.number", "m.is_percent")


@query("SELECT o_orderkey, o_totalprice AS raw_value, o_custkey::DOUBLE AS percent_value, 'down' AS way FROM orders")
def statement_numbers_query(spark: SparkSession, sf: str) -> DataFrame:
    """Sentences about orders, and the numbers found in them; the date is none of them."""
    text = F.concat(F.lit("On "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" the price fell to "), F.format_number("o_totalprice", 2), F.lit(", that is "), F.col("o_custkey").cast("string"), F.lit("% of it"))
    n = table(spark, sf, "orders").select("o_orderkey", direction(text).alias("way"), F.posexplode(statement_numbers(text)).alias("i", "n"))
    return n.groupBy("o_orderkey").agg(F.max(F.when(F.col("n.unit") == "raw", F.col("n.value"))).alias("raw_value"), F.max(F.when(F.col("n.unit") == "percent", F.col("n.value"))).alias("percent_value"), F.max("way").alias("way"))


_SHEET = "SELECT o_orderpriority AS p, year(o_orderdate) AS y, round(sum(o_totalprice), 2) AS v FROM orders GROUP BY 1, 2"


@query("""
SELECT n_name AS name, 'two' || chr(10) || 'lines, "' || n_name || '"' AS note, CAST(n_nationkey AS DOUBLE) AS size FROM nation
UNION ALL SELECT 'name', 'a row like the header', NULL
""")
def csv_scan(spark: SparkSession, sf: str) -> DataFrame:
    """A CSV file with quotes, line breaks inside them and a row like its header, read back whole."""
    out = io.StringIO(newline="")
    rows = [(r["n_name"], f'two\nlines, "{r["n_name"]}"', r["n_nationkey"]) for r in table(spark, sf, "nation").collect()]
    csv.writer(out, lineterminator="\n").writerows([("name", "note", "size"), *rows[:9], ("name", "a row like the header", "size"), *rows[9:]])
    path = write_bytes(spark, f"{scratch_dir(spark)}/nations.csv", out.getvalue().encode())
    return load_tables(spark, path)["nations"].frame


_PARTS = {
    "xl/workbook.xml": '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="nations" sheetId="1" r:id="rId1"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>',
    "xl/styles.xml": '<styleSheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>',
}


@query("SELECT n_name AS name, CAST(DATE '2024-01-01' + CAST(n_nationkey AS INT) AS VARCHAR) AS day, CAST(n_nationkey AS DOUBLE) AS size FROM nation")
def xlsx_scan(spark: SparkSession, sf: str) -> DataFrame:
    """A workbook with texts, days in a date format and numbers, below a title row, read back."""
    text = lambda at, x: f'<c r="{at}" t="inlineStr"><is><t>{x}</t></is></c>'
    body = '<row r="1">' + text("A1", "Nations") + '</row><row r="3">' + "".join(text(f"{c}3", x) for c, x in zip("ABC", ("name", "day", "size"), strict=True)) + "</row>"
    for i, r in enumerate(table(spark, sf, "nation").select("n_name", "n_nationkey").collect(), 4):
        body += f'<row r="{i}">{text(f"A{i}", r["n_name"])}<c r="B{i}" s="1"><v>{45292 + r["n_nationkey"]}</v></c><c r="C{i}"><v>{r["n_nationkey"]}</v></c></row>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, part in (_PARTS | {"xl/worksheets/sheet1.xml": f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{body}</sheetData></worksheet>'}).items():
            z.writestr(name, part)
    path = write_bytes(spark, f"{scratch_dir(spark)}/nations.xlsx", out.getvalue())
    return load_frame(spark, path)[0]


@query(f"""
WITH d AS ({_SHEET}), s AS (SELECT p, sum(v) AS c FROM d GROUP BY 1)
SELECT p || ' subtotal' AS label, 'group' AS scope_type, 'constraints' AS scope, round(c + CASE WHEN p = '2-HIGH' THEN c ELSE 0 END, 2) AS stated, round(c, 2) AS computed, CASE WHEN p = '2-HIGH' THEN 'inconsistent' ELSE 'consistent' END AS status FROM s
UNION ALL SELECT 'Grand total', 'total', 'all_detail', round(sum(c), 2), round(sum(c), 2), 'consistent' FROM s
""")
def reconcile_query(spark: SparkSession, sf: str) -> DataFrame:
    """A sheet of yearly revenue with subtotals, one of them wrong, and a total, held against its own rows."""
    d = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("p"), F.year("o_orderdate").alias("y")).agg(F.round(F.sum("o_totalprice"), 2).alias("v"))
    s = d.groupBy("p").agg(F.sum("v").alias("c"))
    text = lambda x: F.format_number(x, 2)
    rows = d.select(F.concat("p", F.lit("|"), F.col("y").cast("string")).alias("k"), F.array("p", F.concat(F.lit("y"), F.col("y").cast("string")), text(F.col("v"))).alias("cells"))
    rows = rows.unionByName(s.select(F.concat("p", F.lit("|z")).alias("k"), F.array(F.concat("p", F.lit(" subtotal")), F.lit(""), text(F.when(F.col("p") == "2-HIGH", F.col("c") * 2).otherwise(F.col("c")))).alias("cells")))
    rows = rows.unionByName(s.agg(F.sum("c").alias("c")).select(F.lit("~").alias("k"), F.array(F.lit("Grand total"), F.lit(""), text(F.col("c"))).alias("cells")))
    rows = rows.unionByName(spark.createDataFrame([("", ["priority", "year", "amount"])], "k string, cells array<string>"))
    grid = rows.select((F.row_number().over(Window.orderBy("k")) - 1).alias("row_idx"), "cells")
    e = reconcile(grid).entries
    return rounded(e.select("label", "scope_type", "scope", "stated", "computed", "status"), stated=2, computed=2)


@query("""
WITH s AS (SELECT o_orderpriority AS p, count(*) AS n FROM orders GROUP BY 1)
SELECT p AS claim_id, CASE WHEN p = '5-LOW' THEN 'fail' ELSE 'pass' END AS status FROM s
""")
def verify_claims_query(spark: SparkSession, sf: str) -> DataFrame:
    """A claim about each priority's number of orders, one of them false, held against counted evidence."""
    s = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("p")).agg(F.count(F.lit(1)).alias("n"))
    evidence = s.select(F.concat(F.lit("E-"), "p").alias("id"), F.lit("count").alias("kind"), F.lit("orders").alias("key"), F.col("n").cast("double").alias("value"), F.lit(True).alias("verified"))
    said = F.format_number(F.when(F.col("p") == "5-LOW", F.col("n") + 7).otherwise(F.col("n")), 0)
    claims = s.select(F.col("p").alias("claim_id"), F.concat(F.lit("the orders are "), said).alias("statement"), F.lit("L1").alias("level"), F.array(F.concat(F.lit("E-"), "p")).alias("evidence_ids"), F.array(F.lit("none")).alias("limitations"))
    return verify_claims(claims, evidence)["status"]


@query("""
WITH s AS (SELECT o_orderpriority AS p, count(*) AS n FROM orders GROUP BY 1)
SELECT p || ' said' AS claim_id, 'fail' AS severity, 'untraceable_number' AS code FROM s WHERE p = '5-LOW'
UNION ALL SELECT p || ' loose', 'info', 'unresolved_evidence_ids' FROM s
UNION ALL SELECT p || ' loose', 'fail', 'untraceable_number' FROM s WHERE p = '5-LOW'
UNION ALL SELECT p || ' loose', 'warn', 'reconciliation_conflict_unbound' FROM s WHERE p = '1-URGENT'
UNION ALL SELECT p || ' said', 'warn', 'reconciliation_conflict_unbound' FROM s WHERE p = '1-URGENT'
""")
def verify_issues(spark: SparkSession, sf: str) -> DataFrame:
    """Claims on counts with and without evidence of their own, against nested JSON evidence and a sheet that does not add up."""
    counts = table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n")).collect()
    payload = {"evidence": [{"id": f"E-{r['o_orderpriority']}", "kind": "count", "row": 3, "numbers": {"orders": r["n"]}} for r in counts]}
    said = [(r["o_orderpriority"], r["n"] + 7000 * (r["o_orderpriority"] == "5-LOW"), r["n"]) for r in counts]
    claims = [(f"{p} {how}", f"the orders are {x:,}", "L1", [f"E-{p}" if how == "said" else "none"], ["none"]) for p, x, _ in said for how in ("said", "loose")]
    claims = spark.createDataFrame(claims, "claim_id string, statement string, level string, evidence_ids array<string>, limitations array<string>")
    bad = spark.createDataFrame([("R001", float(n), n + 50_000.0, "inconsistent") for p, _, n in said if p == "1-URGENT"], "id string, stated double, computed double, status string")
    return verify_claims(claims, load_evidence(spark, payload), bad)["issues"].select("claim_id", "severity", "code")


@query("""
WITH o AS (SELECT DISTINCT o_custkey, o_orderdate, o_totalprice, o_orderstatus, o_orderpriority FROM orders WHERE o_totalprice > 0)
SELECT date_trunc('month', o_orderdate)::DATE AS month, r_name AS region, count(*) AS orders, count(DISTINCT o_custkey) AS customers, round(sum(o_totalprice), 2) AS revenue
FROM o JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY GROUPING SETS ((date_trunc('month', o_orderdate)::DATE, r_name), ())
""")
def regional_revenue_query(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(regional_revenue(*(table(spark, sf, t) for t in ("orders", "customer", "nation", "region"))), revenue=2)


@query("SELECT * FROM orders WHERE o_custkey IN (SELECT o_custkey FROM (SELECT o_custkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10))")
def top_orders_query(spark: SparkSession, sf: str) -> DataFrame:
    return top_orders(table(spark, sf, "orders")).select(table(spark, sf, "orders").columns)


@query("SELECT ts::DATE AS day, event_type, count(*) AS n, round(sum(value), 2) AS value FROM events GROUP BY 1, 2")
def stream_daily_sums(spark: SparkSession, sf: str) -> DataFrame:
    """The events as a stream, summed by day."""
    batch = table(spark, sf, "events")
    source = spark.readStream.schema(batch.schema).parquet(f"{sf.rstrip('/')}/events.parquet*")
    return rounded(run_to_end(daily_sums(source), f"daily_{uuid4().hex}"), value=2)


@query()
def report_page(spark: SparkSession, sf: str) -> DataFrame:
    """A rendered report on the contribution query, as one row."""
    rows = contribution_query(spark, sf)
    page = render({"meta": {"title": "Revenue by return flag", "subtitle": "1997 against 1996"}, "findings": [{"title": "Change", "body": "Groups and their deltas", "level": "L1", "evidence_ids": ["C-001"]}], "analysis": [{"heading": "Deltas", "charts": [{"type": "bars", "data": chart_rows(rows, "group", "delta")}]}]})
    return spark.createDataFrame([(page,)], "html string")
