"""Data checks. Each returns the offending rows or keys; `run_checks` turns them into results."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillwork.functions.scalars import instant, seconds_between


def unique(df: DataFrame, column: str) -> DataFrame:
    return unique_combo(df.where(F.col(column).isNotNull()), [column])


def unique_combo(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n_records")).where("n_records > 1")


def not_null(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNull())


def relationship(child: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """Keys that the parent lacks, each with the number of child rows that hold it (`n_records`); null
    keys are not checked. Child rows are counted per key first, so a key with very many rows reaches
    the join once."""
    keys = child.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n_records"))
    return keys.join(parent.select(F.col(parent_column).alias(column)), column, "left_anti")


def accepted_values(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    return (df.where(~F.col(column).isin(*values)).groupBy(F.col(column).alias("value_field"))
            .agg(F.count(F.lit(1)).alias("n_records")))


def out_of_range(column: str, low=None, high=None, inclusive: bool = True) -> Column:
    value, bad = F.col(column), F.lit(False)
    if low is not None:
        bad = bad | (value < low if inclusive else value <= low)
    if high is not None:
        bad = bad | (value > high if inclusive else value >= high)
    return bad


def accepted_range(df: DataFrame, column: str, low=None, high=None, inclusive: bool = True) -> DataFrame:
    return df.where(out_of_range(column, low, high, inclusive))


def over_refunded() -> Column:
    return F.col("refunded_amount") > F.col("amount")


def over_refunds(fct: DataFrame) -> DataFrame:
    return (fct.where(over_refunded())
            .select("transaction_id", "amount", "refunded_amount", "refund_count"))


def volume_anomaly(df: DataFrame, day: str, as_of: date, lookback: int = 14, threshold: float = 3) -> DataFrame:
    """The last complete day, if its row count is far from the days before it. The window runs
    over one row per day, so it needs no partitioning."""
    daily = (df.where(F.col(day) < F.lit(as_of)).groupBy(F.col(day).cast("date").alias("day"))
             .agg(F.count(F.lit(1)).alias("row_count")))
    baseline = Window.orderBy("day").rowsBetween(-lookback, -1)
    checked = daily.select("day", "row_count", F.avg("row_count").over(baseline).alias("m"),
                           F.stddev_samp("row_count").over(baseline).alias("s"),
                           F.max("day").over(Window.partitionBy()).alias("last_day"))
    return (checked.where((F.col("day") == F.col("last_day")) & (F.col("s") > 0)
                          & (F.abs(F.col("row_count") - F.col("m")) > threshold * F.col("s")))
            .select("day", "row_count", F.round("m", 1).alias("baseline_mean"),
                    F.round("s", 1).alias("baseline_stddev")))


_ALIASES = {"text": "string", "varchar": "string", "character varying": "string", "jsonb": "string",
            "timestamptz": "timestamp", "timestamp with time zone": "timestamp",
            "timestamp without time zone": "timestamp", "timestamp_ntz": "timestamp",
            "integer": "int", "long": "bigint"}


def type_name(name: str) -> str:
    plain = name.lower().replace(" ", "") if "(" in name else name.lower()
    plain = plain.replace("numeric(", "decimal(")
    return _ALIASES.get(plain, plain)


def contract(df: DataFrame | None, columns: Sequence[dict], table: str = "table") -> DataFrame:
    """Differences between a table and its declared columns as (severity, column_name, finding).

    A missing column, another type or a null where none is allowed is breaking; an undeclared
    column is a warning. Nulls are counted in the data in one pass, as Spark's nullable flag is
    only advice.
    """
    schema = "severity string, column_name string, finding string"
    if df is None:
        return SparkSession.active().createDataFrame([("breaking", None, f"table {table} not found")], schema)
    live = {f.name: type_name(f.dataType.simpleString()) for f in df.schema}
    declared = {c["name"]: c for c in columns}
    found = []
    for name, spec in declared.items():
        if name not in live:
            found.append(("breaking", name, "missing"))
        elif live[name] != type_name(spec["type"]):
            found.append(("breaking", name, f"type {live[name]}, declared {type_name(spec['type'])}"))
    found += [("warning", n, f"not declared ({t})") for n, t in live.items() if n not in declared]
    required = [n for n, c in declared.items() if not c.get("nullable", True) and n in live]
    if required:
        nulls = df.agg(*[F.count_if(F.col(n).isNull()).alias(n) for n in required]).first()
        found += [("breaking", n, "holds nulls") for n in required if nulls[n]]
    return df.sparkSession.createDataFrame(found, schema)


def enforce(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Exactly the declared columns, order, types and metadata. Naive and zoned times are both
    accepted as `timestamp`; a missing column fails here, before anything is written."""
    missing = [f.name for f in schema if f.name not in df.columns]
    if missing:
        raise ValueError(f"columns missing from result: {missing}")
    out = []
    for field in schema:
        have = df.schema[field.name].dataType
        naive = isinstance(field.dataType, T.TimestampType) and isinstance(have, T.TimestampNTZType)
        value = F.col(field.name) if naive or have == field.dataType else F.col(field.name).cast(field.dataType)
        out.append(value.alias(field.name, metadata=field.metadata))
    return df.select(*out)


def freshness(df: DataFrame, ts: str, now: datetime, warn_seconds: int = 900,
              error_seconds: int = 3600) -> DataFrame:
    newest = df.agg(F.max(ts).alias("newest"))
    aged = newest.select("newest", seconds_between("newest", instant(now)).alias("age_seconds"))
    return aged.withColumn("status", F.when(F.col("age_seconds") > error_seconds, "error")
                           .when(F.col("age_seconds") > warn_seconds, "warn")
                           .when(F.col("age_seconds").isNull(), "error").otherwise("pass"))


@dataclass(frozen=True)
class Check:
    """A check that lists its offenders. `weight` names the column that says how many failures an
    offender stands for; without it each is one."""

    name: str
    offending: DataFrame
    severity: str = "error"
    weight: str | None = None


@dataclass(frozen=True)
class RowCheck:
    """A check on single rows of a table: those meeting the condition are the offenders."""

    name: str
    table: DataFrame
    offends: Column
    severity: str = "error"


def _status(result: DataFrame) -> DataFrame:
    return result.withColumn("status", F.when(F.col("failures") == 0, "pass")
                             .when(F.col("severity") == "warn", "warn").otherwise("fail"))


def run_checks(checks: Sequence[Check | RowCheck]) -> DataFrame:
    """One row per check: name, severity, failures and status. All row checks of one table are
    counted in a single pass over it."""
    parts = []
    tables: dict[int, list[RowCheck]] = {}
    for check in checks:
        if isinstance(check, RowCheck):
            tables.setdefault(id(check.table), []).append(check)
            continue
        failures = F.count(F.lit(1)) if check.weight is None else F.coalesce(F.sum(check.weight), F.lit(0)).cast("long")
        parts.append(check.offending.agg(failures.alias("failures")).select(
            F.lit(check.name).alias("name"), F.lit(check.severity).alias("severity"), "failures"))
    for group in tables.values():
        counts = group[0].table.agg(*[F.count_if(c.offends).alias(f"c{i}") for i, c in enumerate(group)])
        rows = F.array(*[F.struct(F.lit(c.name).alias("name"), F.lit(c.severity).alias("severity"),
                                  F.col(f"c{i}").alias("failures")) for i, c in enumerate(group)])
        parts.append(counts.select(F.explode(rows).alias("r")).select("r.*"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionAll(part)
    return _status(out)
