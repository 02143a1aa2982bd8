import copy
from datetime import datetime, timedelta

import pytest

from quillon.config import InputError
from quillon.plans import report
from quillon.streaming.sessions import daily_sums, run_to_end, sessions

SPEC = {
    "meta": {"title": "A <b> title", "degraded": {"read": "a", "unread": "b", "reason": "c"}},
    "kpis": [{"label": "k", "value": 0.5, "unit": "percent", "delta": -0.1, "direction": "down", "good_when_down": True}],
    "findings": [{"title": "t", "body": "b", "level": "L1", "tone": "negative", "evidence_ids": ["E1"]}],
    "analysis": [
        {
            "heading": "h",
            "charts": [
                {"type": "line", "data": [{"label": str(i), "value": v} for i, v in enumerate((1, None, 3, 3))], "baseline": {"value": 2, "label": "base"}, "marker": {"index": 2, "label": "m"}},
                {"type": "bars", "data": [{"label": "a", "value": 3}, {"label": "b", "value": -1, "tone": "negative"}]},
                {"type": "funnel", "data": [{"label": "a", "value": 100}, {"label": "b", "value": 40}], "notes": ["", "40 %"]},
                {"type": "matrix", "rows": ["r"], "columns": ["x", "y"], "cells": {"r|x": 1, "r|y": 2}},
            ],
            "tables": [{"columns": ["a"], "rows": [[1234.5], [None]]}],
        }
    ],
    "conclusions": [{"text": "c", "evidence_ids": ["E1"]}],
    "next_steps": [{"question": "q"}],
}


def test_page(tmp_path):
    page = report.render(SPEC)
    assert page.count("<svg") == 4 and "A &lt;b&gt; title" in page and "1,234.5" in page and page == report.render(copy.deepcopy(SPEC))
    report.write_report(SPEC, str(tmp_path / "x" / "r.html"))
    assert (tmp_path / "x" / "r.html").read_text() == page


@pytest.mark.parametrize(
    ("path", "value"),
    [(("meta", "title"), ""), (("findings",), []), (("findings", 0, "evidence_ids"), []), (("findings", 0, "level"), "L9"), (("findings", 0, "body"), "TODO"), (("analysis", 0, "charts", 0, "type"), "pie"), (("analysis", 0, "charts", 0, "marker", "index"), 9), (("meta", "degraded", "reason"), ""), (("next_steps", 0, "question"), ""), (("kpis", 0, "direction"), "sideways"), (("analysis", 0, "heading"), ""), (("conclusions", 0, "evidence_ids"), None)],
)
def test_problems(path, value):
    spec = copy.deepcopy(SPEC)
    at = spec
    for key in path[:-1]:
        at = at[key]
    at[path[-1]] = value
    assert report.problems(spec)
    with pytest.raises(InputError):
        report.render(spec)


def test_colours_and_numbers():
    assert report.ink_on("#ffffff") == "#000000" and report.ink_on("#000000") == "#ffffff"
    assert [report.number(x) for x in (None, float("nan"), 1234.5, 3, "x")] == ["–", "–", "1,234.5", "3", "x"] and report.number(0.123, "percent") == "12.3%"


def test_streams(spark, tmp_path):
    t = datetime(2026, 1, 1)
    rows = [(u, t + timedelta(minutes=m), "a", 1.0) for u in range(3) for m in (0, 10, 100, 105)]
    spark.createDataFrame(rows, "user_id long, ts timestamp, event_type string, value double").write.parquet(f"{tmp_path}/e")
    source = lambda: spark.readStream.schema("user_id long, ts timestamp, event_type string, value double").parquet(f"{tmp_path}/e")
    assert [(r["n"], r["value"]) for r in run_to_end(daily_sums(source()), "t_daily").collect()] == [(12, 12.0)]
    assert sorted(r["n"] for r in run_to_end(sessions(source()), "t_sessions").collect()) == [2] * 6
