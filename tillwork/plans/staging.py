"""Staging: typed, renamed and deduplicated copies of the raw tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwork.functions.scalars import payload
from tillwork.operators.dedupe import latest_by, latest_whole

APPROVED = ("authorized", "captured", "settled")
FRAUD_REASON = "10.4"


def stg_transactions(raw: DataFrame) -> DataFrame:
    """One row per transaction: client retries share transaction_id, the newest copy wins. Copies are typed
    before it is told, as the payload's fields are narrower than its text."""
    return latest_by(typed_transactions(raw), ["transaction_id"], [F.col("updated_at").desc(), F.col("source_row_id").desc()])


def newest_transactions(raw: DataFrame, key: Sequence[str] = ("transaction_id",), whole: bool = False) -> DataFrame:
    """The newest copy of each transaction. Other columns that tell transactions apart may be the key: if the
    rows are already dealt by one of them, none move. `whole` is for narrow rows that several plans share."""
    take = latest_whole if whole else latest_by
    return take(raw, key, [F.col("updated_at").desc(), F.col("id").desc()])


def typed_transactions(newest: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Typed columns, and those to `keep` as they are."""
    parsed = newest.withColumn("_p", payload("raw_payload"))
    return parsed.select(
        *keep, "transaction_id", F.col("id").alias("source_row_id"), "merchant_id", "customer_id", "card_token",
        "customer_email", F.col("amount").cast("decimal(18,2)").alias("amount"),
        F.upper("currency").alias("currency"), "status", F.col("status").isin(*APPROVED).alias("is_approved"),
        "entry_mode", (F.col("entry_mode") == "ecommerce").alias("is_card_not_present"), "ip_country",
        F.col("_p.network").alias("card_network"), F.col("_p.response_code").alias("response_code"),
        F.col("_p.avs_result").alias("avs_result"), F.col("_p.cvv_result").alias("cvv_result"),
        F.col("_p.three_ds.version").alias("three_ds_version"),
        F.col("_p.three_ds.authenticated").cast("boolean").alias("three_ds_authenticated"),
        F.col("_p.network_risk_score").cast("int").alias("network_risk_score"),
        F.col("_p.device.type").alias("device_type"), F.col("_p.device.os").alias("device_os"),
        F.to_date("created_at").alias("transaction_date"), "created_at", "updated_at")


def stg_merchants(raw: DataFrame) -> DataFrame:
    return raw.select("merchant_id", F.col("name").alias("merchant_name"), "category", "mcc", "country",
                      "currency", "card_present", "created_at", "updated_at")


def stg_customers(raw: DataFrame) -> DataFrame:
    return raw.select("customer_id", "full_name", "email", "phone", "country", "created_at", "updated_at")


def stg_cards(raw: DataFrame) -> DataFrame:
    return raw.select("card_token", "customer_id", "brand", "bin", "last4", "issuer_country", "created_at")


def stg_refunds(raw: DataFrame) -> DataFrame:
    return raw.select("refund_id", "transaction_id", F.col("amount").cast("decimal(18,2)").alias("amount"),
                      "reason", "created_at", "updated_at")


def stg_chargebacks(raw: DataFrame) -> DataFrame:
    return raw.select("chargeback_id", "transaction_id", F.col("amount").cast("decimal(18,2)").alias("amount"),
                      "reason_code", "reason", F.col("status").alias("chargeback_status"),
                      (F.col("reason_code") == FRAUD_REASON).alias("is_fraud"), "created_at", "updated_at")
