"""One row per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_by(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row per key in the given order.

    The filter on row_number lets Spark keep one row per key before the shuffle as well as after
    it, so a key with very many copies sends at most one row per input task.
    """
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def latest_whole(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The same with the row as one value, so that no column is dropped below the window. Parts of one plan that
    read different columns of the result then have the same shuffle below it, which is made once."""
    first = Window.partitionBy(*key).orderBy(*order)
    row = F.first(F.struct(*[c for c in df.columns if c not in key])).over(first)
    return df.select(*key, row.alias("_row"), F.row_number().over(first).alias("_rank")).where("_rank = 1").select(*key, "_row.*")


def repeats(df: DataFrame, key: Sequence[str]) -> bool:
    """Whether a key may occur twice, told by its hash, so that eight bytes of a row move. Two keys of one
    hash give a true as well."""
    return not df.groupBy(F.xxhash64(*key).alias("_h")).count().where("count > 1").isEmpty()


def meets(changes: DataFrame, table: DataFrame, key: Sequence[str]) -> tuple[bool, bool]:
    """Whether a key may occur twice among the changes, and whether the table may have one of them; told by
    hashes as in `repeats`, both in one pass."""
    hashed = F.xxhash64(*key).alias("_h")
    both = changes.select(hashed, F.lit(1).alias("_new")).unionAll(table.select(hashed, F.lit(0).alias("_new")))
    new = F.sum("_new")
    found = both.groupBy("_h").agg(new.alias("new"), (F.count(F.lit(1)) - new).alias("old")).agg(
        F.coalesce(F.bool_or(F.col("new") > 1), F.lit(False)).alias("twice"),
        F.coalesce(F.bool_or((F.col("new") > 0) & (F.col("old") > 0)), F.lit(False)).alias("both")).first()
    return found["twice"], found["both"]


def latest_with_ties(df: DataFrame, key: Sequence[str], ts: str) -> DataFrame:
    """All rows at the newest `ts` of their key. The newest time is pre-aggregated per input task
    and joined back; AQE splits a hot key in that join."""
    newest = df.groupBy(*key).agg(F.max(ts).alias(ts))
    return df.join(newest, [*key, ts], "left_semi")


def top_n(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)

