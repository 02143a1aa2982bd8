"""Profiles of tables, and the gate that says whether a table can be analysed and which days to leave out."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.config import InputError
from quillon.functions.exprs import col, num, typed_day

FLAGS = "check string, severity string, field string, day date, value double, detail string"


def profile_fields(df: DataFrame, exact: bool = True) -> DataFrame:
    """One row for each field: nulls, distinct values, numbers and dates, from one wide aggregate."""
    kinds = dict(df.dtypes)
    aggs = [F.count(F.lit(1)).alias("_n")]
    for i, c in enumerate(df.columns):
        x, d = num(c), typed_day(df, c) if kinds[c] in ("date", "timestamp", "timestamp_ntz", "string") else F.lit(None).cast("date")
        distinct = F.count_distinct(col(c)) if exact else F.approx_count_distinct(col(c))
        numeric = kinds[c] not in ("date", "timestamp", "timestamp_ntz", "boolean", "binary") and not kinds[c].startswith(("array", "map", "struct"))
        x = x if numeric else F.lit(None).cast("double")
        middle = F.percentile(x, F.lit(0.5)) if exact else F.percentile_approx(x, F.lit(0.5))
        aggs.append(F.struct(F.lit(c).alias("field"), F.lit(kinds[c]).alias("type"), F.count_if(col(c).isNull()).alias("missing_count"), distinct.alias("unique_count"), F.count(x).alias("numeric_count"), F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), middle.alias("median"), F.count(d).alias("date_count"), F.min(d).alias("first_day"), F.max(d).alias("last_day")).alias(f"_f{i}"))
    wide = df.agg(*aggs)
    rows = wide.select("_n", F.explode(F.array(*(f"_f{i}" for i in range(len(df.columns))))).alias("f")).select("_n", "f.*")
    filled = F.col("_n") - F.col("missing_count")
    return rows.select("field", "type", "missing_count", F.try_divide(F.col("missing_count").cast("double"), F.col("_n").cast("double")).alias("missing_rate"), "unique_count", ((F.col("numeric_count") >= 0.8 * F.col("_n")) & (F.col("numeric_count") >= 2)).alias("is_numeric"), ((F.col("date_count") >= 0.8 * F.col("_n")) & (filled > 0)).alias("is_date_candidate"), "min", "max", "mean", "std", "median", "first_day", "last_day")


def profile_table(df: DataFrame, date_field: str | None = None) -> DataFrame:
    """One row: rows, columns, duplicate rows, and the span of days with how many are missing."""
    distinct = df.select(F.xxhash64(*(F.col(f"`{c}`") for c in df.columns)).alias("h"), *([typed_day(df, date_field).alias("d")] if date_field else [F.lit(None).cast("date").alias("d")]))
    out = distinct.agg(F.count(F.lit(1)).alias("rows"), (F.count(F.lit(1)) - F.count_distinct("h")).alias("duplicate_rows"), F.min("d").alias("first_day"), F.max("d").alias("last_day"), F.count_distinct("d").alias("unique_days"))
    return out.withColumn("columns", F.lit(len(df.columns))).withColumn("missing_days", F.greatest(F.lit(0), F.datediff("last_day", "first_day") + 1 - F.col("unique_days")))


@dataclass(frozen=True)
class Contract:
    """What a table's fields mean, and the gate's policy."""

    date_field: str | None = None
    metric_fields: Mapping[str, str] = field(default_factory=dict)
    key_fields: Sequence[str] = ()
    min_sample: float = 4
    outlier_z: float = 4.0
    missing_rate_floor: float = 0.05
    delay_exclusion_minutes: float = 120.0

    @classmethod
    def from_dict(cls, spec: Mapping) -> Contract:
        fields = spec.get("fields", {})
        metrics = spec.get("metric_fields")
        metrics = {k: v for k, v in fields.items() if k != "date"} if metrics is None else metrics
        if not isinstance(fields, Mapping) or not isinstance(metrics, Mapping):
            raise InputError("fields and metric_fields have to be objects")
        policy = {k: float(v) for k, v in (spec.get("quality") or {}).items() if k in ("min_sample", "outlier_z", "missing_rate_floor", "delay_exclusion_minutes")}
        return cls(spec.get("date_field") or fields.get("date"), dict(metrics), tuple(spec.get("key_fields", ())), **policy)


def date_gaps(df: DataFrame, date_field: str) -> DataFrame:
    """(day): the days between the first and the last that have no row."""
    days = df.select(typed_day(df, date_field).alias("day")).where(F.col("day").isNotNull()).distinct()
    span = days.agg(F.min("day").alias("a"), F.max("day").alias("b")).where(F.col("a").isNotNull())
    return span.select(F.explode(F.sequence("a", "b")).alias("day")).join(days, "day", "left_anti")


def quality_gate(df: DataFrame, contract: Contract, exclude: bool = True) -> dict[str, DataFrame]:
    """{"flags": what was found, "excluded": days to leave out, "status": PASS, DEGRADED or BLOCK}.

    Checks: repeated dates, missing days, missing values, outliers on the high side, late or patchy days (metrics
    named delay_minutes and missing_rate), fields the contract names but the table lacks, empty metrics.
    """
    spark = df.sparkSession
    present = {role: f for role, f in contract.metric_fields.items() if f in df.columns}
    dated = contract.date_field in df.columns if contract.date_field else False
    day = typed_day(df, contract.date_field) if dated else F.lit(None).cast("date")
    base = df.select(day.alias("day"), *(num(f).alias(f"m_{r}") for r, f in present.items()))
    flag = lambda rows, check, severity, name, value=None, detail="": rows.select(F.lit(check).alias("check"), F.lit(severity).alias("severity"), F.lit(name).alias("field"), (F.col("day") if "day" in rows.columns else F.lit(None).cast("date")).alias("day"), (value if value is not None else F.lit(None)).cast("double").alias("value"), F.lit(detail).alias("detail"))
    lost = [(f"{r}={f}") for r, f in contract.metric_fields.items() if f not in df.columns] + [f"date={contract.date_field}"] * bool(contract.date_field and not dated)
    flags = [spark.createDataFrame([("missing_contract_field", "error", x.split("=", 1)[1], None, None, x.split("=", 1)[0]) for x in lost], FLAGS)]
    if dated:
        flags.append(flag(base.where(F.col("day").isNotNull()).groupBy("day").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1), "duplicate_date", "warning", contract.date_field, F.col("n") - 1))
        flags.append(flag(date_gaps(df, contract.date_field), "date_gap", "warning", contract.date_field))
    fields = profile_fields(df.select(*(col(c) for c in df.columns)), exact=False) if df.columns else None
    gaps = fields.where(F.col("missing_rate") >= 0.2).select(F.lit("field_missing").alias("check"), F.when(F.col("missing_rate") >= 0.5, "error").otherwise("warning").alias("severity"), "field", F.lit(None).cast("date").alias("day"), F.col("missing_rate").alias("value"), F.lit("").alias("detail"))
    flags.append(gaps)
    out_days = []
    for role, f in present.items():
        x = F.col(f"m_{role}")
        s = base.agg(F.percentile(x, F.lit(0.5)).alias("med"), F.stddev_samp(x).alias("sd"), F.count(x).alias("n"))
        # one row beside the table
        dev = base.where(x.isNotNull()).join(F.broadcast(s), F.lit(True)).withColumn("_d", F.abs(x - F.col("med")))
        mad = dev.agg(F.percentile("_d", F.lit(0.5)).alias("mad"))
        dev = dev.join(F.broadcast(mad), F.lit(True)).withColumn("_s", F.greatest(F.col("mad"), F.coalesce("sd", F.lit(0.0)) / 3, F.lit(1e-12)) * 1.4826)
        if role in ("delay_minutes", "missing_rate"):
            limit = F.col("med") + 3 * F.col("_s")
            limit = F.greatest(limit, F.lit(contract.missing_rate_floor)) if role == "missing_rate" else limit
            late = dev.where((F.col("n") >= contract.min_sample) & (x > limit) & (F.lit(True) if role == "missing_rate" else limit >= contract.delay_exclusion_minutes))
            flags.append(flag(late, f"{role}_excluded", "warning", f, x))
            out_days.append(late.select("day", F.lit(role).alias("reason")))
        else:
            far = dev.where((F.col("n") >= contract.min_sample) & ((x - F.col("med")) / F.col("_s") > contract.outlier_z))
            flags.append(flag(far, "metric_outlier", "warning", f, (x - F.col("med")) / F.col("_s")))
            out_days.append(base.where(x.isNull()).select("day", F.lit(f"empty {f}").alias("reason")))
    found = reduce(DataFrame.unionByName, flags)
    excluded = reduce(DataFrame.unionByName, out_days).where(F.col("day").isNotNull()).distinct() if out_days and exclude else spark.createDataFrame([], "day date, reason string")
    resolved = bool(present) or dated or any(k in df.columns for k in contract.key_fields)
    errors = found.agg(F.count(F.lit(1)).alias("flags"), F.count_if(F.col("severity") == "error").alias("errors"))
    status = errors.withColumn("status", F.when((F.col("errors") > 0) & F.lit(not resolved), "BLOCK").when(F.col("flags") > 0, "DEGRADED").otherwise("PASS"))
    return {"flags": found, "excluded": excluded, "status": status}
