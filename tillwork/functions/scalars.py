"""Column expressions shared by the models. All of them stay inside JVM codegen."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from tillwork.schemas import PAYLOAD


def json_field(column: str, path: str) -> Column:
    """Scalar at a dotted path of a JSON text, as a string; null when missing or JSON null."""
    return F.get_json_object(column, f"$.{path}")


def payload(column: str) -> Column:
    """The card-network response parsed once, for callers that read several of its fields."""
    return F.from_json(column, PAYLOAD)


def mask_email(column: str, key: str | None = None) -> Column:
    """Hash of the normalised address: md5, or keyed sha-256 when a key is given."""
    normal = F.lower(F.trim(column))
    return F.md5(normal) if key is None else F.sha2(F.concat(F.lit(key), normal), 256)


def mask_last4(column: str) -> Column:
    return F.right(F.col(column), F.lit(4))


def to_cad(amount: Column, rate: Column) -> Column:
    return F.round(amount * rate, 2)


def later(a: Column, b: Column) -> Column:
    return F.greatest(a, F.coalesce(b, a))


def micros(ts: str | Column) -> Column:
    """Microseconds since the epoch of a UTC time, zoned or not."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(ts.cast("timestamp"))


def instant(value: datetime | date) -> Column:
    """A naive UTC time as a literal, whatever the time zone of the driver."""
    return F.lit(value.isoformat()).cast("timestamp_ntz")


def seconds_between(start: str | Column, end: str | Column) -> Column:
    return (micros(end) - micros(start)) / F.lit(1_000_000.0)


def as_number(column: Column) -> Column:
    """Feature value of a loosely typed field: missing is NaN, booleans are 0 or 1."""
    text = F.lower(column.cast("string"))
    return (F.when(text == "true", 1.0).when(text == "false", 0.0)
            .otherwise(F.coalesce(text.try_cast("double"), F.lit(float("nan")))))


def drift_value(column: str) -> Column:
    """Value compared by drift checks: booleans are 0 or 1 and missing is -1."""
    return F.coalesce(F.col(column).cast("double"), F.lit(-1.0))


def short_error(column: Column) -> Column:
    return F.substring(column, 1, 500)


def known_count(column: str) -> Column:
    """Row counts below zero mean the engine did not report one."""
    return F.when(F.col(column) >= 0, F.col(column))


def parse_time(column: Column) -> Column:
    return F.try_to_timestamp(column)
