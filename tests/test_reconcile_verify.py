import pytest
from pyspark.sql import functions as F

from quillon.functions.text import parse_money, statement_numbers
from quillon.plans.reconcile import reconcile
from quillon.plans.reconcile import column_names
from quillon.plans.verify import flatten_evidence, load_evidence, verify_claims


def grid(spark, rows):
    return spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "row_idx int, cells array<string>")


CLEAN = [["Report", "", ""], ["region", "month", "amount"], ["East", "1", "1000"], ["East", "2", "2000"], ["East subtotal", "", "3000"], ["West", "1", "1500"], ["West", "2", "2500"], ["West subtotal", "", "4000"], ["Grand total", "", "7000"], ["rate", "", "0.6"]]


def outcome(spark, rows, **how):
    r = reconcile(grid(spark, rows), **how)
    return r, r.summary.first(), {e["row"]: e for e in r.entries.collect()}


def test_clean_sheet(spark):
    r, s, e = outcome(spark, CLEAN)
    assert (r.header_row, s["status"], s["exit_code"], s["checked"]) == (1, "pass", 0, 3)
    assert e[5]["computed"] == 3000 and e[9]["scope"] == "all_detail" and e[5]["id"] == "R001"


def test_wrong_total_and_subtotal(spark):
    bad = [list(r) for r in CLEAN]
    bad[8][2] = "99000"
    _, s, e = outcome(spark, bad)
    assert s["status"] == "fail" and s["exit_code"] == 1 and e[9]["diff"] == 92000
    bad = [list(r) for r in CLEAN]
    bad[4][2] = "4500"
    _, s, e = outcome(spark, bad)
    assert e[5]["status"] == "inconsistent" and e[9]["status"] == "consistent"


def test_summary_word_in_another_column(spark):
    rows = [["region", "month", "amount"], ["East", "Jan", "1"], ["East", "Feb", "2"], ["East", "小计", "3"], ["West", "Jan", "4"], ["West", "小计", "4"], ["合计", "", "7"]]
    _, s, _ = outcome(spark, rows, absolute=0.0, relative=0.0)
    assert s["status"] == "pass" and s["checked"] == 3


def test_tolerance_and_none(spark):
    rows = [["item", "amount"], ["a", ".334"], ["b", "0.333"], ["total", "0.67"]]
    rows[1][1] = "0.334"
    assert outcome(spark, rows)[1]["status"] == "pass"
    assert outcome(spark, rows, absolute=1e-4, relative=0)[1]["status"] == "fail"
    assert outcome(spark, [["date", "orders"], ["2026-01-01", "3"]])[1]["status"] == "no_summary_rows"


@pytest.mark.parametrize(("cell", "number"), [("1,234.50", 1234.5), ("(65.50)", -65.5), ("¥12", 12.0), ("１２３", 123.0), ("12%", 12.0), ("abc", None), ("--", None), (None, None), ("1.2万", None), ("\u00a01,234", 1234.0), ("1\u00a0234", 1234.0), ("\u200912\u3000", 12.0), ("①", 1.0), ("（65）", -65.0)])
def test_cells(spark, cell, number):
    got = spark.createDataFrame([(cell,)], "c string").select(parse_money(F.col("c")).alias("m")).first()["m"]
    assert got["number"] == number


def test_statement_numbers(spark):
    text = "On 2011-11-02 sales fell -20.45% to 1,234.56, up 3 pp"
    got = spark.createDataFrame([(text,)], "c string").select(statement_numbers(F.col("c")).alias("n")).first()["n"]
    assert [(n["value"], n["unit"], n["sign"]) for n in got] == [(-20.45, "percent", -1), (1234.56, "raw", None), (3.0, "pp", None)]


CLAIM = "claim_id string, statement string, level string, status string, evidence_ids array<string>, limitations array<string>, identification_strategy string, date_window string"
EVIDENCE = "id string, kind string, key string, value double, verified boolean"


def codes(spark, claims, evidence, recon=None):
    e = spark.createDataFrame(evidence, EVIDENCE)
    r = verify_claims(spark.createDataFrame(claims, CLAIM), e, recon)
    return {(i["claim_id"], i["code"]) for i in r["issues"].collect()}, r["overall"].first()["status"]


def claim(text, ids=("E1",), level="L1", status="confirmed", strategy=None, window=None, name="C1"):
    return (name, text, level, status, list(ids), ["none"], strategy, window)


@pytest.mark.parametrize(
    ("text", "key", "value", "ok"),
    [("11.6%", "rate", 0.116, True), ("rate 0.116", "value", 11.6, False), ("95%", "value", 0.826, False), ("fell by 20.45%", "delta", -0.2045, True), ("rose by 20.45%", "delta", -0.2045, False), ("group 3 has 632", "value", 632.0, True)],
)
def test_numbers_are_traced(spark, text, key, value, ok):
    got, _ = codes(spark, [claim(text)], [("E1", "op", key, value, True)])
    assert (("C1", "untraceable_number") not in got) is ok


def test_scope_causality_and_counts(spark):
    evidence = [("E1", "op", "value", 632.0, True), ("E2", "op", "value", 900.0, True)]
    assert ("C1", "untraceable_number") in codes(spark, [claim("A is 900")], evidence)[0]
    assert ("C1", "causal_language_below_l2") in codes(spark, [claim("632 caused it")], evidence)[0]
    two = ("E1", "E2")
    assert ("C1", "causal_language_without_identification") in codes(spark, [claim("632 caused it", two, "L2")], evidence)[0]
    assert codes(spark, [claim("632 caused it", two, "L2", strategy="did")], evidence) == (set(), "pass")
    many = [claim("632", status="hypothesis", window="w", name=f"C{i}") for i in range(8)]
    assert {c for _, c in codes(spark, many, evidence)[0]} == {"multiple_comparison_risk", "repeated_window_checks"}
    assert ("C1", "no_evidence_provided") in codes(spark, [claim("632")], [])[0]


def test_reconciliation_is_held_against_claims(spark):
    recon = spark.createDataFrame([("R001", 99000.0, 7000.0, "inconsistent")], "id string, stated double, computed double, status string")
    evidence = [("R001", "reconciliation", "stated", 99000.0, False), ("R001", "reconciliation", "computed", 7000.0, False)]
    assert ("C1", "reconciliation_mismatch") in codes(spark, [claim("total 99000", ["R001"])], evidence, recon)[0]
    assert codes(spark, [claim("stated 99000, computed 7000", ["R001"])], evidence, recon)[1] == "pass"


def test_names_and_headers(spark):
    assert column_names(["a", "", "a", "a__2"], 5) == ["a", "__col_2", "a__2", "a__2__2", "__col_5"]
    rows = [["无", "不适用", "x"], ["", "Report", ""], ["region", "month", "amount"], ["East", "1", "5"], ["合计", "", "5"]]
    r, s, _ = outcome(spark, rows)
    assert r.header_row == 2 and s["status"] == "pass"
    assert outcome(spark, [[""]])[1]["status"] == "no_summary_rows"


def test_nested_evidence(spark):
    payload = {"schema_version": 3, "evidence": [{"id": "E1", "kind": "op", "row": 7, "value": 632, "parts": {"share": 0.25, "deep": [{"delta": -3, "ok": True, "bad": float("nan")}]}}, {"id": "E2", "status": "consistent"}, {"value": 9}]}
    assert flatten_evidence(payload) == [("E1", "op", "value", 632.0, False), ("E1", "op", "share", 0.25, False), ("E1", "op", "delta", -3.0, False), ("E2", None, "", None, True)]
    assert flatten_evidence({"a": [1, {"rate": 0.5}]}) == [(None, None, "", 1.0, False), (None, None, "rate", 0.5, False)] and flatten_evidence(5) == [(None, None, "", 5.0, False)]
    e = load_evidence(spark, payload, {"evidence": [{"id": "E1", "value": 700}]})
    assert {(r["id"], r["value"]) for r in e.collect()} == {("E1", 700.0), ("E2", None)}
    got, _ = codes(spark, [claim("A is 632 and 25%")], flatten_evidence(payload))
    assert got == set()


def test_bags_and_unresolved_claims(spark):
    bag = flatten_evidence({"a": [632, {"rate": 0.116}], "big": 123456789.0})
    got, status = codes(spark, [claim("A is 632, 11.6%, of 123,456,789"), claim("A is 633", name="C2"), claim("", name="C3")], bag)
    assert got == {("C1", "unscoped_evidence"), ("C2", "unscoped_evidence"), ("C2", "untraceable_number"), ("C3", "missing_statement")} and status == "fail"
    got, _ = codes(spark, [claim("A is 632", ["none"]), claim("A is 9", ["none"], name="C2")], [("E1", "op", "value", 632.0, True)])
    assert got == {("C1", "unresolved_evidence_ids"), ("C2", "unresolved_evidence_ids"), ("C2", "untraceable_number")}


def test_percentages_of_a_cell_that_does_not_add_up(spark):
    recon = spark.createDataFrame([("R1", 0.6, 0.2, "inconsistent"), ("R2", 5e6, 1.0, "inconsistent"), ("R3", 0.0, 1.0, "inconsistent")], "id string, stated double, computed double, status string")
    got, _ = codes(spark, [claim("it is 60%", ["E1"]), claim("5,000,001 in all", ["R2"], name="C2"), claim("none", name="C3")], [("E1", "op", "rate", 0.6, True), ("R2", "r", "stated", 5e6, False)], recon)
    assert ("C1", "reconciliation_conflict_unbound") in got and ("C2", "reconciliation_mismatch") in got and not {k for k in got if k[0] == "C3" and "recon" in k[1]}
