"""Claims against evidence: where a statement's numbers come from, and what it may say.

Evidence is a table (id, kind, key, value, verified) with one row for each number; ``load_evidence`` makes it from nested JSON.
Claims are a table with claim_id, statement, level, status, evidence_ids, limitations, identification_strategy,
date_window. A claim's numbers are held against the evidence that it names; where it names none that there is, against all,
which meet by the magnitude of the numbers. Rows without an id are a bag of numbers that no claim can name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.text import CAUSAL_WORDS, CAUSAL_WORDS_EN, direction, has_any, label_numbers, statement_numbers, unit_of_key

TOLERANCE, MAX_EXPLORATORY = 0.051, 5
#: Ways to identify a cause.
STRATEGIES = ("randomized", "ab_test", "did", "difference_in_differences", "matching", "iv", "instrumental_variable", "rdd", "regression_discontinuity", "synthetic_control")
EVIDENCE = "id string, kind string, key string, value double, verified boolean"
#: Where evidence files keep their entries, and fields of an entry that say where it is from.
ENTRY_LISTS = ("evidence", "entries", "reconciliations", "items", "results")
PROVENANCE = frozenset(
    "id kind scope scope_type column sheet file path name sha256 row rows row_number detail_rows detail_row_numbers header_row index label op status verified severity code message limitations tried unit schema_version reason detail source binding".split()
)
ISSUES = "claim_id string, severity string, code string, detail string"


def _numbers(node: Any, skip: frozenset[str] = frozenset()) -> Iterator[tuple[str, float]]:
    """(key, value) of all finite numbers in nested JSON, in order; the key is the field that holds the number, empty in lists."""
    todo = [("", node)]
    while todo:
        key, at = todo.pop()
        if isinstance(at, Mapping):
            todo += reversed([(str(k), v) for k, v in at.items() if str(k) not in skip])
        elif isinstance(at, (list, tuple)):
            todo += reversed([("", v) for v in at])
        elif isinstance(at, (int, float)) and not isinstance(at, bool) and math.isfinite(at):
            yield key, float(at)


def flatten_evidence(payload: Any) -> list[tuple[str | None, str | None, str, float | None, bool]]:
    """Rows of evidence of a JSON document: a list of entries with ids, or an object that holds one.

    An entry has a row for each of its numbers, provenance fields left out, and one without a number if it has none. It is
    verified if it says so or, saying nothing, if its status is consistent. A document without entries is a bag: its numbers have no id.
    """
    lists = [payload] if isinstance(payload, list) else [payload[k] for k in ENTRY_LISTS if isinstance(payload.get(k), list)][:1] if isinstance(payload, Mapping) else []
    entries = [e for found in lists for e in found if isinstance(e, Mapping) and e.get("id")]
    if not entries:
        return [(None, None, k, v, False) for k, v in _numbers(payload)]
    out = []
    for e in entries:
        whose = (str(e["id"]), None if e.get("kind") is None else str(e["kind"]))
        sure = bool(e.get("verified", e.get("status") == "consistent"))
        out += [(*whose, k, v, sure) for k, v in _numbers(e, PROVENANCE)] or [(*whose, "", None, sure)]
    return out


def load_evidence(spark: SparkSession, *payloads: Any) -> DataFrame:
    """The evidence table of one or more JSON documents; an entry of a later one replaces that of the same id."""
    entries: dict[str, list] = {}
    bag: list = []
    for payload in payloads:
        rows = flatten_evidence(payload)
        for name in {r[0] for r in rows if r[0] is not None}:
            entries[name] = []
        for r in rows:
            (bag if r[0] is None else entries[r[0]]).append(r)
    return spark.createDataFrame([*(r for rows in entries.values() for r in rows), *bag], EVIDENCE)


def _step(x: Column, tolerance: float) -> Column:
    """A block number of a size: sizes within the tolerance lie in one block or in two next to each other."""
    t = max(float(tolerance), 1e-9)
    place = F.when(x <= t * 1e6, x / t).otherwise(1e6 * (1 + F.log(F.greatest(x, F.lit(t)) * 1e-6 / t)))
    return F.floor(place / 2).cast("bigint")


def _close(a: Column, b: Column, tolerance: float) -> Column:
    return F.abs(a - b) <= F.greatest(F.greatest(F.abs(a), F.abs(b)) * 1e-6, F.lit(float(tolerance)))


def number_matches(value: Column, unit: Column, sign: Column, way: Column, evidence: Column, evidence_unit: Column, tolerance: float = TOLERANCE) -> Column:
    """Whether a stated number is an evidence number: sizes first, a percentage as a ratio too, then the direction."""
    a, b = F.abs(value), F.abs(evidence)
    size = F.when(unit == "raw", _close(a, b, tolerance)).when(evidence_unit == "raw", _close(a / 100, b, tolerance)).otherwise(_close(a, b, tolerance) | _close(a / 100, b, tolerance))
    side = F.signum(evidence)
    turn = F.when(sign.isNotNull(), (side == 0) | (side == sign)).when(way == "down", side < 0).when(way == "up", side > 0).otherwise(F.lit(True))
    return size & turn


def number_present(statement: Column, value: Column, tolerance: float = TOLERANCE) -> Column:
    """Whether a statement has a number of that size, or of a hundred times it."""
    target = F.abs(value)
    ratio = lambda x: (x != 0) & (target != 0) & (F.abs(F.try_divide(x, target) - 100) <= 0.5)
    return F.coalesce(F.exists(statement_numbers(statement), lambda n: _close(F.abs(n["value"]), target, tolerance) | ratio(F.abs(n["value"]))), F.lit(False))


def verify_claims(claims: DataFrame, evidence: DataFrame, reconciliations: DataFrame | None = None, tolerance: float = TOLERANCE, strict: bool = False, require_evidence: bool = True, lenient_numbers: bool = False, max_exploratory: int = MAX_EXPLORATORY) -> dict[str, DataFrame]:
    """{"issues": (claim_id, severity, code, detail), "status": (claim_id, status), "overall": one row}.

    ``reconciliations`` is what ``reconcile`` gives (id, stated, computed, status).
    """
    have = {"level": "string", "status": "string", "evidence_ids": "array<string>", "limitations": "array<string>", "identification_strategy": "string", "date_window": "string", "decomposition_closed": "boolean"}
    c = claims.select("claim_id", F.coalesce("statement", F.lit("")).alias("statement"), *((F.col(k) if k in claims.columns else F.lit(None)).cast(t).alias(k) for k, t in have.items()))
    c = c.withColumn("level", F.upper(F.trim(F.coalesce("level", F.lit(""))))).withColumn("ids", F.coalesce("evidence_ids", F.array().cast("array<string>")))
    high = F.col("level").isin("L2", "L3", "L4")
    causal = has_any(F.col("statement"), CAUSAL_WORDS + CAUSAL_WORDS_EN)
    strategy = F.lower(F.trim(F.coalesce("identification_strategy", F.lit(""))))
    rules = [
        (F.trim("statement") == "", "fail", "missing_statement"),
        (F.size("ids") == 0, "fail", "missing_evidence"),
        (F.col("limitations").isNull() | (high & (F.size("limitations") == 0)), "warn", "missing_limitations"),
        (F.col("level") == "", "warn", "missing_level"),
        (causal & ~high, "fail", "causal_language_below_l2"),
        (causal & high & ~strategy.isin(*STRATEGIES), "fail", "causal_language_without_identification"),
        (high & (F.size("ids") < 2) & ~F.coalesce("decomposition_closed", F.lit(False)), "fail", "l2_insufficient_evidence"),
    ]
    issue = lambda df, severity, code, detail: df.select("claim_id", F.lit(severity).alias("severity"), F.lit(code).alias("code"), F.coalesce(detail, F.lit("")).alias("detail"))
    plain = c.select("claim_id", F.explode(F.filter(F.array(*(F.when(cond, F.struct(F.lit(s).alias("severity"), F.lit(k).alias("code"), F.lit("").alias("detail"))) for cond, s, k in rules)), lambda x: x.isNotNull())).alias("i")).select("claim_id", "i.*")
    found = [plain]

    e = evidence.select(F.col("id").cast("string").alias("id"), F.col("kind").cast("string").alias("kind"), unit_of_key(F.coalesce("key", F.lit(""))).alias("e_unit"), F.col("value").cast("double").alias("e_value"))
    bound = c.select("claim_id", F.explode(F.array_distinct("ids")).alias("id")).join(e.select("id").distinct(), "id", "left_semi").groupBy("claim_id").agg(F.count(F.lit(1)).alias("bound"))
    have = e.agg(F.count("id").alias("entries"), F.sum((F.col("id").isNull() & F.col("e_value").isNotNull()).cast("int")).alias("bag"))
    state = c.join(bound, "claim_id", "left").join(F.broadcast(have)).na.fill(0, ["bound", "bag"])
    some = F.trim("statement") != ""
    if require_evidence:
        found.append(issue(state.where(some & (F.col("entries") == 0) & (F.col("bag") == 0)), "fail", "no_evidence_provided", F.lit("")))
    found.append(issue(state.where(some & (F.col("entries") > 0) & (F.col("bound") == 0)), "fail" if strict else "info", "unresolved_evidence_ids", F.array_join("ids", ", ")))
    found.append(issue(state.where(some & (F.col("entries") == 0) & (F.col("bag") > 0)), "fail" if strict else "warn", "unscoped_evidence", F.lit("")))

    numbers = c.select("claim_id", "ids", direction(F.col("statement")).alias("way"), label_numbers(F.col("statement")).alias("labels"), F.posexplode(statement_numbers(F.col("statement"))).alias("pos", "n"))
    all_numbers = numbers.select("claim_id", "ids", F.abs("n.value").alias("size"))
    numbers = numbers.where(~F.exists("labels", lambda x: F.abs(x - F.abs(F.col("n.value"))) <= 1e-9)).select("claim_id", "ids", "way", "pos", "n.*")
    matching = number_matches(F.col("value"), F.col("unit"), F.col("sign"), F.col("way"), F.col("e_value"), F.col("e_unit"), tolerance)
    own = numbers.select("claim_id", "pos", "value", "unit", "sign", "way", F.explode("ids").alias("id")).join(e.where(F.col("id").isNotNull()), "id")
    # numbers of claims that name no evidence meet the bag, or all entries if there is none, by magnitude
    free = state.where(some & (F.col("bound") == 0) & ((F.col("entries") > 0) | (F.col("bag") > 0))).select("claim_id", (F.col("bag") > 0).alias("in_bag"))
    size = F.abs("value")
    near = F.explode(F.array_distinct(F.array(_step(size, tolerance), _step(size / 100, tolerance)))).alias("step")
    step = _step(F.abs("e_value"), tolerance)
    pool = e.where(F.col("e_value").isNotNull()).select(F.col("id").isNull().alias("of_bag"), "e_unit", "e_value", F.explode(F.array(step - 1, step, step + 1)).alias("step")).distinct()
    loose = numbers.join(free, "claim_id").select("claim_id", "pos", "value", "unit", "sign", "way", "in_bag", near).join(pool, "step").where(F.col("in_bag") == F.col("of_bag"))
    hit = own.where(matching).select("claim_id", "pos").unionByName(loose.where(matching).select("claim_id", "pos")).distinct()
    checked = bound.select("claim_id").unionByName(free.select("claim_id"))
    traced = numbers.join(checked, "claim_id", "left_semi").join(hit, ["claim_id", "pos"], "left_anti").groupBy("claim_id").agg(F.array_join(F.array_sort(F.collect_list("raw")), ", ").alias("raws"))
    found.append(issue(traced, "warn" if lenient_numbers else "fail", "untraceable_number", F.col("raws")))

    if reconciliations is not None:
        bad = reconciliations.where(F.col("status") == "inconsistent").select(F.col("id").alias("rid"), "stated", "computed")
        # statements with a number of the stated size, or of a hundred times it, meet the cell by magnitude
        target = F.abs("stated")
        hundredth = lambda x: F.floor(F.log(F.greatest(x, F.lit(1e-300))) / 0.02).cast("bigint")
        around = lambda s: F.array(s - 1, s, s + 1)
        tag = lambda kind, s: F.transform(s, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("step")))
        asked = bad.select("rid", "stated", "computed", F.explode(F.concat(tag(0, around(_step(target, tolerance))), tag(1, around(hundredth(target))))).alias("at"))
        given = all_numbers.select("claim_id", F.explode(F.concat(tag(0, F.array(_step(F.col("size"), tolerance))), tag(1, F.array(hundredth(F.col("size") / 100))))).alias("at")).distinct()
        pairs = given.join(asked, "at").select("claim_id", "rid", "stated", "computed").distinct()
        said = c.join(pairs, "claim_id").where(number_present(F.col("statement"), F.col("stated"), tolerance) & ~number_present(F.col("statement"), F.col("computed"), tolerance))
        ours = F.array_contains("ids", F.col("rid"))
        found.append(issue(said.where(ours), "fail", "reconciliation_mismatch", F.col("rid")))
        found.append(issue(said.where(~ours), "warn", "reconciliation_conflict_unbound", F.col("rid")))

    explored = c.where(F.col("status").isin("hypothesis", "exploratory", "exploration")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max_exploratory).select(F.lit(None).cast("string").alias("claim_id"), F.col("n").cast("string").alias("d"))
    found.append(issue(explored, "warn", "multiple_comparison_risk", F.col("d")))
    repeated = c.where(F.col("date_window").isNotNull() & (F.size("ids") > 0)).groupBy("date_window").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= 3).select(F.lit(None).cast("string").alias("claim_id"), F.col("date_window").alias("d"))
    found.append(issue(repeated, "warn", "repeated_window_checks", F.col("d")))

    issues = reduce(DataFrame.unionByName, found)
    weight = F.when(F.col("severity") == "fail", 2).when(F.col("severity") == "warn", 1).otherwise(0)
    name = lambda n: F.when(n == 2, "fail").when(n == 1, "warn").otherwise("pass")
    worst = issues.where(F.col("claim_id").isNotNull()).groupBy("claim_id").agg(F.max(weight).alias("w"))
    status = c.select("claim_id").join(worst, "claim_id", "left").select("claim_id", name(F.coalesce("w", F.lit(0))).alias("status"))
    overall = issues.agg(F.coalesce(F.max(weight), F.lit(0)).alias("w")).select(name(F.col("w")).alias("status"), (F.col("w") == 2).cast("int").alias("exit_code"))
    return {"issues": issues, "status": status, "overall": overall}
