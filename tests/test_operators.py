import math
from datetime import date, datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillon.config import InputError
from quillon.functions.stats import chi_square_p, chi_square_tail, normal_p, normal_two_sided
from quillon.registry import load, run

DAY = date(2026, 1, 1)


def codes(result):
    return {r["code"] for r in result.limitations.collect()}


def one(result, name="summary"):
    return result[name].first()


def test_tails(spark):
    for x, df in ((3.8415, 1), (5.9915, 2), (7.8147, 3)):
        assert chi_square_tail(x, df) == pytest.approx(0.05, abs=1e-3)
    assert chi_square_tail(0, 3) == 1
    rows = spark.createDataFrame([(float(x), k) for x in (0.0, 0.3, 2.0, 3.8415, 9.0, 30.0) for k in (1, 2, 3, 4, 7)], "x double, k int")
    for r in rows.select("x", "k", chi_square_p(F.col("x"), F.col("k")).alias("p"), normal_p(F.col("x")).alias("z")).collect():
        assert r["p"] == pytest.approx(chi_square_tail(r["x"], r["k"]), rel=1e-10)
        assert r["z"] == pytest.approx(normal_two_sided(r["x"]), rel=1e-10, abs=1e-300)


def test_power(spark):
    r = run("power_mde", spark, {"baseline_rate": 0.5, "mde_absolute": 0.05, "daily_traffic_per_arm": 500})
    s = one(r)
    assert 1500 < s["n_control"] < 1650 and s["days"] == math.ceil(s["n_control"] / 500)
    curve = [c["n_per_arm"] for c in r["curve"].orderBy("effect").collect()]
    assert curve == sorted(curve, reverse=True)
    back = one(run("power_mde", spark, {"baseline_rate": 0.5, "n_per_arm": s["n_control"]}))
    assert back["detectable_effect"] == pytest.approx(0.05, abs=0.005)
    assert one(run("power_mde", spark, {"baseline_rate": 0.8, "n_per_arm": 10}))["detectable_effect"] is None
    assert one(run("power_mde", spark, {"metric_type": "continuous", "baseline_mean": 100, "baseline_sd": 30, "mde_relative": 0.05}))["n_control"] > 0


def test_sample_ratio(spark):
    def verdict(a, b, **how):
        df = spark.createDataFrame([(i, "A" if i < a else "B") for i in range(a + b)], "uid long, variant string")
        return one(run("srm_check", df, {"variant_field": "variant", "unit_field": "uid", **how}))["verdict"]

    assert verdict(1003, 997) == "pass" and verdict(1080, 820) == "block"
    assert verdict(900, 100, expected_ratio={"A": 0.9, "B": 0.1}) == "pass"
    assert verdict(900, 100, expected_ratio={"A": 1.0}) == "unlisted_variant"
    crossed = spark.createDataFrame([(1, "A"), (1, "B"), (2, "A"), (3, "B")], "uid long, variant string")
    r = run("srm_check", crossed, {"variant_field": "variant", "unit_field": "uid"})
    assert one(r)["cross_assigned"] == 1 and one(r)["verdict"] == "block"
    assert {"SRM_EQUAL_SPLIT_ASSUMED", "SRM_LOW_EXPECTED", "SRM_CROSS_ASSIGNED"} <= codes(r)


def test_multiple_testing(spark):
    tests = [{"label": str(i), "p_value": p, "prespecified": i == 0} for i, p in enumerate((0.002, 0.011, 0.03, 0.04, 0.2))]
    r = run("multiple_testing", spark, {"tests": tests})
    s = one(r)
    assert s["rejected_bonferroni"] <= s["rejected_holm"] <= s["rejected_bh"] <= s["rejected_raw"]
    assert all(x["bh"] >= x["p_value"] for x in r["rows"].collect()) and "MT_EXPLORATORY" in codes(r)
    for bad in ({"tests": []}, {"tests": [{"p_value": 1.4}]}, {"tests": tests, "alpha": 1.5}):
        with pytest.raises(InputError):
            run("multiple_testing", spark, bad)


def test_cuped(spark):
    rng = np.random.default_rng(11)
    pre = rng.normal(100, 20, 4000)
    arm = rng.integers(0, 2, 4000)
    post = 0.8 * pre + 3 * arm + rng.normal(0, 10, 4000)
    pdf = pd.DataFrame({"v": np.where(arm, "B", "A"), "y": post, "x": pre})
    r = run("cuped", spark.createDataFrame(pdf), {"variant_field": "v", "metric_field": "y", "covariate_field": "x"})
    rows = {x["estimate"]: x for x in r["rows"].collect()}
    assert one(r)["variance_reduction"] > 0.5 and one(r)["balanced"]
    assert rows["adjusted"]["effect"] == pytest.approx(3, abs=1) and rows["adjusted"]["se"] < rows["raw"]["se"]
    theta = np.cov(post, pre)[0, 1] / pre.var(ddof=1)
    adj = post - theta * (pre - pre.mean())
    assert rows["adjusted"]["effect"] == pytest.approx(adj[arm == 1].mean() - adj[arm == 0].mean())


def series(spark, values):
    return spark.createDataFrame([(str(DAY + timedelta(days=i)), float(v)) for i, v in enumerate(values)], "date string, orders double")


def test_change_points(spark):
    rng = np.random.default_rng(3)
    df = series(spark, np.concatenate((rng.normal(1000, 30, 50), rng.normal(880, 30, 40))))
    r = run("changepoint_scan", df, {"date_field": "date", "metric_field": "orders"})
    best = one(r, "level_shift")
    assert abs((best["break_date"] - DAY).days - 50) <= 3 and best["shift"] < 0 and best["p_value"] < 0.01
    assert r["cusum"].count() >= 1
    quiet = run("changepoint_scan", series(spark, rng.normal(1000, 30, 90)), {"date_field": "date", "metric_field": "orders", "seasonality": "none"})
    assert "CP_NO_SEASONALITY" in codes(quiet)
    assert "CP_TOO_SHORT" in codes(run("changepoint_scan", series(spark, [1, 2, 3]), {"date_field": "date", "metric_field": "orders"}))


def test_attribution(spark):
    t0 = datetime(2026, 1, 1)
    rows = [(u, c, t0 + timedelta(days=i), int(i == 2), 100.0 * (i == 2)) for u in range(50) for i, c in enumerate("abc")]
    df = spark.createDataFrame(rows, "uid long, channel string, ts timestamp, conv int, value double")
    config = {"id_field": "uid", "channel_field": "channel", "timestamp_field": "ts", "conversion_field": "conv", "value_field": "value"}
    r = run("attribution", df, config)
    got = {x["channel"]: x for x in r["rows"].collect()}
    assert got["a"]["first_touch"] == 5000 and got["c"]["last_touch"] == 5000 and got["b"]["linear"] == pytest.approx(5000 / 3)
    assert got["c"]["time_decay"] > got["a"]["time_decay"] and all(x["matches"] for x in r["reconciliation"].collect())
    assert "ATTR_TRUNCATED" in codes(run("attribution", df, config | {"lookback_days": 1}))


def test_cohorts(spark):
    rows = [(f"{c}-{i}", str(date(2026, 1, 5) + timedelta(weeks=c + w))) for c in range(6) for i in range(20) for w in range(0, 8) if w == 0 or (i + w) % 3]
    r = run("cohort_retention", spark.createDataFrame(rows, "uid string, date string"), {"id_field": "uid", "date_field": "date", "max_periods": 8, "min_cohort_size": 10})
    got = r["rows"].collect()
    assert all(x["rate"] == 1 for x in got if x["offset"] == 0) and {x["mature"] for x in got} == {True, False}
    assert all(0 <= x["rate"] <= 1 for x in got) and "COHORT_IMMATURE" in codes(r)


def test_survival(spark):
    rng = np.random.default_rng(13)
    days = np.concatenate((rng.exponential(20, 300), rng.exponential(40, 300)))
    pdf = pd.DataFrame({"plan": ["A"] * 300 + ["B"] * 300, "days": np.minimum(days, 60).round(1), "churned": (days < 60).astype(int)})
    r = run("survival", spark.createDataFrame(pdf), {"duration_field": "days", "event_field": "churned", "group_field": "plan", "survival_at_times": [7, 30]})
    curve = r["curve"].toPandas().sort_values(["group", "time"])
    for name, part in pdf.groupby("plan"):
        s = 1.0
        for t in sorted(part.days[part.churned == 1].unique()):
            s *= 1 - ((part.days == t) & (part.churned == 1)).sum() / (part.days >= t).sum()
        assert curve[curve.group == name].survival.iloc[-1] == pytest.approx(s, abs=1e-9)
    median = {x["group"]: x["median"] for x in r["summary"].collect()}
    assert median["A"] < median["B"] and one(r, "log_rank")["p_value"] < 0.01 and r["at_times"].count() == 4
    assert "SURV_ALL_EVENTS" in codes(run("survival", spark.createDataFrame(pdf), {"duration_field": "days"}))
    ends = spark.createDataFrame([(1.0,), (2.0,), (2.0,)], "days double")
    assert [x["survival"] for x in run("survival", ends, {"duration_field": "days"})["curve"].orderBy("time").collect()] == pytest.approx([2 / 3, 0])


def test_paths(spark):
    t0 = datetime(2026, 1, 1)
    rows = [(u, s, t0 + timedelta(minutes=2 * i)) for u in range(30) for i, s in enumerate(["home", "list", "detail", "cart", "pay"] if u % 3 == 0 else ["home", "list", "detail", "detail", "exit"])]
    r = run("path_analysis", spark.createDataFrame(rows, "uid long, step string, ts timestamp"), {"id_field": "uid", "step_field": "step", "timestamp_field": "ts", "terminal_steps": ["pay"], "session_gap_minutes": 30})
    assert one(r)["terminal_reach_rate"] == pytest.approx(1 / 3) and r["paths"].count() == 2
    loops = [x for x in r["transitions"].collect() if x["self_loop"]]
    assert [(x["from_step"], x["count"]) for x in loops] == [("detail", 20)]
    cut = run("path_analysis", spark.createDataFrame(rows, "uid long, step string, ts timestamp"), {"id_field": "uid", "step_field": "step", "timestamp_field": "ts", "max_steps": 2})
    assert one(cut)["truncated"] == 30 and {"PATH_TRUNCATED", "PATH_NO_TERMINAL", "PATH_NO_SESSION_GAP"} <= codes(cut)


def test_rfm(spark):
    rng = np.random.default_rng(17)
    rows = [(f"u{u:04d}", str(date(2026, 6, 30) - timedelta(days=int(rng.integers(0, 300)))), float(rng.gamma(2, 50))) for u in range(200) for _ in range(int(rng.integers(1, 20)))]
    rows += [("best", str(date(2026, 6, 30)), 900.0)] * 40 + [("worst", "2025-07-01", 1.0)]
    r = run("rfm", spark.createDataFrame(rows, "uid string, date string, amount double"), {"id_field": "uid", "date_field": "date", "value_field": "amount"})
    e = r["entities"].toPandas().set_index("id")
    assert e.loc["best", "segment"] == "high_value_active" and e.loc["worst", "segment"] == "dormant"
    seg = r["segments"].toPandas()
    assert seg["size"].sum() == len(e) == 202 and seg["share"].sum() == pytest.approx(1) and r["cutoffs"].count() == 6
    order = e.reset_index().sort_values(["monetary", "id"])
    assert list(order["m"]) == [min(5, max(1, math.ceil((i + 1) / 202 * 5))) for i in range(202)]


def test_elasticity(spark):
    rng = np.random.default_rng(19)
    p = rng.uniform(50, 150, 200)
    pdf = pd.DataFrame({"price": p, "qty": np.exp(10 - 1.5 * np.log(p) + rng.normal(0, 0.1, 200)), "sku": ["a", "b"] * 100})
    r = run("price_elasticity", spark.createDataFrame(pdf), {"price_field": "price", "quantity_field": "qty", "group_field": "sku"})
    s = one(r)
    assert s["elasticity"] == pytest.approx(-1.5, abs=0.15) and s["demand_type"] == "elastic" and s["if_price_rises"] == "revenue_falls"
    assert r["groups"].count() == 2 and s["max_claim_level"] == "L1"
    flat = one(run("price_elasticity", spark.createDataFrame(pdf.assign(price=5.0)), {"price_field": "price", "quantity_field": "qty"}))
    assert flat["error"] == "no_price_variation" and flat["elasticity"] is None


def test_anomalies(spark):
    values = [1000 + 5 * (i % 7) for i in range(90)]
    values[2], values[46] = 800, 3000
    config = {"date_field": "date", "metric_field": "orders"}
    r = run("anomaly_scan", series(spark, values), config)
    top = r["rows"].orderBy(F.abs("robust_z").desc()).first()
    assert (top["date"] - DAY).days == 46 and r["rows"].count() + r["excluded"].count() == 90
    assert {x["excluded"] for x in r["excluded"].collect()} == {"warmup_period"}
    opened = run("anomaly_scan", series(spark, values), config | {"warmup_days": 0, "min_baseline_n": 0})
    assert {(x["date"] - DAY).days for x in opened["excluded"].collect()} == {0, 1, 2}
    assert {x["baseline"] for x in run("anomaly_scan", series(spark, [7] * 25), config)["rows"].collect()} == {"rolling"}


def test_base_operators(spark):
    rows = [(str(DAY + timedelta(days=i)), "AB"[i % 2], 100 + i, 50 + i, 10.0 * i) for i in range(20)]
    df = spark.createDataFrame(rows, "date string, channel string, visitors long, orders long, amount double")
    f = run("funnel_rates", df, {"stages": ["visitors", {"field": "orders", "name": "bought"}]})
    assert [x["loss"] for x in f["rows"].orderBy("position").collect()] == [None, 1000.0]
    c = run("contribution", df, {"group_field": "channel", "value_field": "amount", "current_filter": {"date": {"from": "2026-01-11"}}, "baseline_filter": {"date": {"to": "2026-01-10"}}})
    got = c["rows"].collect()
    assert sum(x["share_of_gap"] for x in got) == pytest.approx(1) and sum(x["delta"] for x in got) == one(c)["gap"]
    d = run("ratio_decomp", df, {"group_field": "channel", "numerator_field": "orders", "denominator_field": "visitors", "current_filter": {"date": {"from": "2026-01-11"}}, "baseline_filter": {"date": {"to": "2026-01-10"}}})
    s = one(d)
    assert s["within_total"] + s["mix_total"] + s["interaction_residual"] == pytest.approx(s["rate_delta"])
    p = run("segment_profile", df, {"segment_field": "channel", "metrics": [{"field": "amount", "agg": "mean"}]})
    assert [x["share"] for x in p["rows"].collect()] == [0.5, 0.5]
    a = one(run("ab_effect", df, {"variant_field": "channel", "metric_field": "amount", "metric_type": "continuous"}))
    assert a["effect"] == pytest.approx(10) and a["ci_low"] < 10 < a["ci_high"]


FULL = {
    "funnel_rates": {"stages": ["visitors", "orders"]},
    "contribution": {"group_field": "channel", "value_field": "amount"},
    "ratio_decomp": {"group_field": "channel", "numerator_field": "orders", "denominator_field": "visitors"},
    "ab_effect": {"variant_field": "channel", "metric_field": "orders"},
    "segment_profile": {"segment_field": "channel"},
    "anomaly_scan": {"date_field": "date", "metric_field": "orders"},
    "attribution": {"id_field": "channel", "channel_field": "channel", "timestamp_field": "date"},
    "cohort_retention": {"id_field": "channel", "date_field": "date"},
    "survival": {"duration_field": "orders", "group_field": "channel"},
    "path_analysis": {"id_field": "channel", "step_field": "channel", "timestamp_field": "date"},
    "rfm": {"id_field": "channel", "date_field": "date", "value_field": "amount"},
    "price_elasticity": {"price_field": "amount", "quantity_field": "orders"},
    "srm_check": {"variant_field": "channel"},
    "cuped": {"variant_field": "channel", "metric_field": "orders", "covariate_field": "visitors"},
    "changepoint_scan": {"date_field": "date", "metric_field": "orders"},
}
BAD = {
    "one_row": [("2026-01-01", "A", "10", "5", "1.5")],
    "empty": [],
    "zeros": [("2026-01-01", "A", "0", "0", "0"), ("2026-01-02", "B", "0", "0", "0")],
    "text": [("2026-01-01", "A", "x", "y", None), ("nonsense", "B", "z", "", "w")],
    "negatives": [("2026-01-01", "A", "-10", "5", "-1"), ("2026-01-01", None, "20", "5", "3")],
    "huge": [("2026-01-01", "A", "1e308", "1e300", "1e308"), ("2026-01-02", "B", "1e308", "1e300", "1e308")],
}


@pytest.mark.parametrize("op", sorted(FULL))
def test_degenerate_inputs(spark, op):
    """Whatever the cells hold, an operator gives tables or an input error."""
    rows = [(name, *r) for name, rs in BAD.items() for r in rs]
    for name in BAD:
        df = spark.createDataFrame([r[1:] for r in rows if r[0] == name], "date string, channel string, visitors string, orders string, amount string")
        r = run(op, df, FULL[op])
        for t in r.tables.values():
            t.collect()
        r.limitations.collect()
    with pytest.raises(InputError):
        run(op, df, {})


def test_registry():
    assert len(load()) == 17
    with pytest.raises(InputError):
        run("nothing")


def test_contribution_of_a_published_case(spark):
    rows = [("base", "UK", 766233.1733333333), ("base", "other", 158586.93333333332), ("now", "UK", 1258370.8800000001), ("now", "other", 168216.66)]
    r = run("contribution", spark.createDataFrame(rows, "period string, region string, revenue double"), {"group_field": "region", "value_field": "revenue", "current_filter": {"period": "now"}, "baseline_filter": {"period": "base"}})
    got = {x["group"]: x for x in r["rows"].collect()}
    assert one(r)["gap"] == pytest.approx(501767.4333333331)
    assert got["UK"]["share_of_gap"] == pytest.approx(0.9808083864616431) and got["UK"]["evidence_id"] == "C-001"
    assert got["other"]["delta"] == pytest.approx(9629.726666666684) and got["other"]["evidence_id"] == "C-002"


def test_row_order_does_not_matter(spark):
    t0 = datetime(2026, 1, 1)
    rows = [(u, "abcd"[(u * 7 + i) % 4], t0 + timedelta(hours=i // 2), (u + i) % 5 == 0, float(i)) for u in range(40) for i in range(9)]
    df = spark.createDataFrame(rows, "uid long, step string, ts timestamp, conv boolean, value double").withColumn("conv", F.col("conv").cast("int"))
    for op, config, name in (
        ("attribution", {"id_field": "uid", "channel_field": "step", "timestamp_field": "ts", "conversion_field": "conv", "value_field": "value"}, "rows"),
        ("path_analysis", {"id_field": "uid", "step_field": "step", "timestamp_field": "ts", "session_gap_minutes": 30}, "paths"),
        ("rfm", {"id_field": "uid", "date_field": "ts", "value_field": "value"}, "entities"),
    ):
        a, b = (sorted(map(repr, ([round(v, 6) if isinstance(v, float) else v for v in r] for r in run(op, d, config)[name].collect()))) for d in (df, df.orderBy(F.rand(5)).repartition(7)))
        assert a == b, op


def test_rows_of_one_entity_in_many_sessions(spark):
    t0 = datetime(2026, 1, 1)
    rows = [(1, "s", t0 + timedelta(hours=i)) for i in range(500)]
    r = run("path_analysis", spark.createDataFrame(rows, "uid long, step string, ts timestamp"), {"id_field": "uid", "step_field": "step", "timestamp_field": "ts", "session_gap_minutes": 30, "terminal_steps": ["s"]})
    assert one(r)["sequences"] == 500 and one(r)["terminal_reach_rate"] == 1
