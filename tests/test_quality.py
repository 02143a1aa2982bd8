from datetime import date, timedelta

from quillon.plans.quality import Contract, date_gaps, profile_fields, profile_table, quality_gate

ROWS = [(str(date(2026, 1, 1) + timedelta(days=i)), 100.0 + i % 3, 10.0) for i in range(30) if i != 7] + [("2026-01-02", 100.0, 10.0)]


def frame(spark, rows=ROWS):
    return spark.createDataFrame(rows, "date string, orders double, delay double")


def test_profile(spark):
    got = {r["field"]: r for r in profile_fields(frame(spark)).collect()}
    assert got["date"]["is_date_candidate"] and got["orders"]["is_numeric"] and got["orders"]["max"] == 102
    t = profile_table(frame(spark), "date").first()
    assert (t["rows"], t["missing_days"], t["duplicate_rows"], t["columns"]) == (30, 1, 0, 3)
    assert [str(r["day"]) for r in date_gaps(frame(spark), "date").collect()] == ["2026-01-08"]


def gate(spark, rows=ROWS, **spec):
    contract = Contract.from_dict({"date_field": "date", "metric_fields": {"pay_success": "orders", "delay_minutes": "delay"}} | spec)
    out = quality_gate(frame(spark, rows), contract)
    return {r["check"] for r in out["flags"].collect()}, out["status"].first()["status"], {str(r["day"]) for r in out["excluded"].collect()}


def test_gate(spark):
    assert gate(spark) == ({"duplicate_date", "date_gap"}, "DEGRADED", set())
    clean = [r for r in ROWS[:7]]
    assert gate(spark, clean) == (set(), "PASS", set())
    odd = [*ROWS, ("2026-02-01", 5000.0, 10.0), ("2026-02-02", None, 900.0)]
    checks, status, days = gate(spark, odd)
    assert {"metric_outlier", "delay_minutes_excluded"} <= checks and status == "DEGRADED" and days == {"2026-02-02"}
    assert gate(spark, metric_fields={"pay_success": "nothing"}, date_field="no")[1] == "BLOCK"
    assert gate(spark, metric_fields={"pay_success": "nothing"})[1] == "DEGRADED"
    empty = [(None, None, None)] * 5
    assert "field_missing" in gate(spark, empty)[0]
