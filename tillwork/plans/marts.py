"""Marts: adjustments per transaction, the transaction fact, dimensions and the daily volume."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwork import schemas
from tillwork.functions.scalars import instant, later, mask_email, to_cad
from tillwork.operators.quality import enforce
from tillwork.operators.upsert import upsert
from tillwork.session import materialize, small
from tillwork.sources.store import CODEC


def refund_rollup(refunds: DataFrame) -> DataFrame:
    return refunds.groupBy("transaction_id").agg(
        F.count(F.lit(1)).alias("refund_count"),
        F.sum("amount").cast("decimal(38,2)").alias("refunded_amount"),
        F.max("updated_at").alias("updated_at"))


def chargeback_rollup(chargebacks: DataFrame) -> DataFrame:
    """The status kept is the last in text order: won over open over lost."""
    return chargebacks.groupBy("transaction_id").agg(
        F.count(F.lit(1)).alias("chargeback_count"),
        F.sum("amount").cast("decimal(38,2)").alias("chargeback_amount"),
        F.bool_or("is_fraud").alias("has_fraud_chargeback"),
        F.max("chargeback_status").alias("chargeback_status"),
        F.max("updated_at").alias("updated_at"))


def transaction_adjustments(refunds: DataFrame, chargebacks: DataFrame) -> DataFrame:
    r = refund_rollup(refunds).withColumnRenamed("updated_at", "r_updated")
    c = chargeback_rollup(chargebacks).withColumnRenamed("updated_at", "c_updated")
    zero = F.lit(0)
    return r.join(c, "transaction_id", "full_outer").select(
        "transaction_id", F.coalesce("refund_count", zero).alias("refund_count"),
        F.coalesce("refunded_amount", zero.cast("decimal(38,2)")).alias("refunded_amount"),
        F.coalesce("chargeback_count", zero).alias("chargeback_count"),
        F.coalesce("chargeback_amount", zero.cast("decimal(38,2)")).alias("chargeback_amount"),
        F.coalesce("has_fraud_chargeback", F.lit(False)).alias("has_fraud_chargeback"),
        "chargeback_status", F.greatest("r_updated", "c_updated").alias("updated_at"))


def fct_transactions(transactions: DataFrame, adjustments: DataFrame, fx: DataFrame, dealt: str | None = None) -> DataFrame:
    """One row per transaction with its refund and chargeback outcome, amounts also in CAD.

    An unknown currency leaves the CAD amounts null, for the not-null check to report. `dealt` names a column
    of both by which the transactions lie already: adjustments then come to them, and none of them moves.
    """
    a = adjustments.withColumnRenamed("updated_at", "adjusted_at").drop("chargeback_amount")
    adjusted = transactions.join(a, "transaction_id", "left") if dealt is None else _looked_up(transactions, a, dealt)
    joined = adjusted.join(small(fx), "currency", "left")
    refunded = F.coalesce("refunded_amount", F.lit(0).cast("decimal(38,2)"))
    ready = joined.select(
        "*", mask_email("customer_email").alias("customer_email_hash"),
        to_cad(F.col("amount"), F.col("rate_to_cad")).alias("amount_cad"),
        to_cad(refunded.cast("decimal(24,2)"), F.col("rate_to_cad")).alias("refunded_amount_cad"),
        later(F.col("updated_at"), F.col("adjusted_at")).alias("last_changed_at"),
    ).withColumns({
        "refund_count": F.coalesce("refund_count", F.lit(0)),
        "refunded_amount": refunded,
        "chargeback_count": F.coalesce("chargeback_count", F.lit(0)),
        "has_fraud_chargeback": F.coalesce("has_fraud_chargeback", F.lit(False)),
    })
    return enforce(ready, schemas.FCT_TRANSACTIONS)


def _looked_up(transactions: DataFrame, adjustments: DataFrame, dealt: str) -> DataFrame:
    """The left join on transaction_id as one on `dealt` alone, since a join on both columns would deal the rows
    again: adjustments come as one map for each value."""
    given = [c for c in adjustments.columns if c not in ("transaction_id", dealt)]
    entry = F.struct("transaction_id", F.struct(*given))
    maps = (adjustments.where(F.col("transaction_id").isNotNull()).groupBy(dealt)
            .agg(F.map_from_entries(F.collect_list(entry)).alias("_adjustments")))
    found = transactions.join(maps, dealt, "left").withColumn("_found", F.col("_adjustments")[F.col("transaction_id")])
    return found.select(*transactions.columns, *[F.col("_found")[c].alias(c) for c in given])


def changed_transactions(transactions: DataFrame, refunds: DataFrame, chargebacks: DataFrame, mark) -> DataFrame:
    """Ids whose own row, refund or chargeback is newer than the mark. The filters are on source
    columns, so they reach the scans and only new rows are read here."""
    ids = [df.where(F.col("updated_at") > instant(mark)).select("transaction_id")
           for df in (transactions, refunds, chargebacks)]
    return ids[0].unionAll(ids[1]).unionAll(ids[2]).distinct()


def fct_incremental(target: DataFrame | None, transactions: DataFrame, refunds: DataFrame,
                    chargebacks: DataFrame, fx: DataFrame, dealt: tuple[str, Callable[[str], Column]] | None = None) -> DataFrame:
    """The fact after the changes since its newest last_changed_at. Only changed transactions and
    their adjustments go through the joins. An absent or empty target is a first load. The changes are
    pinned, so that the old rows stay where they are unless very many of them are replaced."""
    mark = None if target is None else target.agg(F.max("last_changed_at")).first()[0]
    fresh = fct_changes(mark, transactions, refunds, chargebacks, fx, dealt)
    if mark is None:
        return fresh
    return upsert(target, materialize(fresh, "fresh", CODEC), ["transaction_id"], unique=True)


def fct_changes(mark, transactions: DataFrame, refunds: DataFrame, chargebacks: DataFrame, fx: DataFrame,
                dealt: tuple[str, Callable[[str], Column]] | None = None) -> DataFrame:
    """Fact rows changed since the mark; all of them when there is no mark. `dealt` is the column by which the
    transactions lie already and how transaction_id gives it: then the rows are told after the joins, in which
    no transaction moves."""
    if dealt is not None:
        column, of_id = dealt
        rows = fct_transactions(transactions, transaction_adjustments(refunds, chargebacks).withColumn(column, of_id("transaction_id")), fx, column)
        return rows if mark is None else rows.where(F.col("last_changed_at") > instant(mark))
    kept = since(mark, transactions, refunds, chargebacks)
    return fct_transactions(kept[0], transaction_adjustments(kept[1], kept[2]), fx)


def since(mark, *tables: DataFrame) -> tuple[DataFrame, ...]:
    """The rows of all tables that belong to a transaction changed since the mark. Works on raw
    tables as well, so that staging only sees what changed."""
    if mark is None:
        return tables
    changed = changed_transactions(*tables, mark)
    return tuple(df.join(changed, "transaction_id", "left_semi") for df in tables)


def dim_merchants(history: DataFrame) -> DataFrame:
    """Current version of each merchant."""
    current = history.where(F.col("valid_to").isNull()).withColumnRenamed("name", "merchant_name")
    return enforce(current, schemas.DIM_MERCHANTS)


def merchant_daily(fct: DataFrame) -> DataFrame:
    """Measures per day and merchant, without merchant names: what the incremental run keeps."""
    n = F.count(F.lit(1))

    def share(condition):
        return F.round(F.count_if(condition).cast("double") / n, 4)

    return fct.groupBy("transaction_date", "merchant_id").agg(
        n.alias("transaction_count"),
        F.count_if("is_approved").alias("approved_count"),
        F.count_if(~F.col("is_approved")).alias("declined_count"),
        share(~F.col("is_approved")).alias("decline_rate"),
        F.sum(F.when(F.col("is_approved"), F.col("amount_cad")).otherwise(0)).alias("approved_volume_cad"),
        F.sum("refunded_amount_cad").alias("refunded_volume_cad"),
        F.sum("chargeback_count").alias("chargeback_count"),
        F.count_if("has_fraud_chargeback").alias("fraud_chargeback_count"),
        share(F.col("is_card_not_present")).alias("card_not_present_share"))


def merchant_daily_volume(fct: DataFrame, dim: DataFrame) -> DataFrame:
    """Daily volume and risk per merchant in CAD.

    The fact is aggregated to (day, merchant) before the dimension is joined, so the join moves
    day rows rather than transactions and a busy merchant is combined before any shuffle.
    """
    return named_daily(merchant_daily(fct), dim)


def named_daily(daily: DataFrame, dim: DataFrame) -> DataFrame:
    named = daily.join(dim.select("merchant_id", "merchant_name", "category", "country"), "merchant_id")
    return enforce(named, schemas.MERCHANT_DAILY_VOLUME)
