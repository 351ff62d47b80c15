"""Schemas of the payment tables, with the classification of each column as field metadata."""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {
    "string": T.StringType(), "bigint": T.LongType(), "int": T.IntegerType(), "boolean": T.BooleanType(),
    "double": T.DoubleType(), "date": T.DateType(), "timestamp": T.TimestampType(),
    "money": T.DecimalType(18, 2), "total": T.DecimalType(38, 2), "rate": T.DecimalType(12, 6),
}


def struct(spec: str, classes: dict[str, str] | None = None, pii: tuple[str, ...] = ()) -> T.StructType:
    """Build a schema from 'name type, name type!' where ! marks a column that must not be null."""
    fields = []
    for item in spec.split(","):
        name, kind = item.split()
        required = kind.endswith("!")
        metadata = {}
        if classes and name in classes:
            metadata["classification"] = classes[name]
        if name in pii:
            metadata["pii"] = True
        fields.append(T.StructField(name, _TYPES[kind.rstrip("!")], not required, metadata))
    return T.StructType(fields)


_DIRECT = ("full_name", "email", "phone", "customer_email")
_RESTRICTED = {name: "restricted" for name in _DIRECT}

RAW_TRANSACTIONS = struct(
    "id bigint!, transaction_id string!, merchant_id string!, customer_id string!, card_token string!,"
    "customer_email string, amount money!, currency string!, status string!, entry_mode string!,"
    "ip_country string, raw_payload string, created_at timestamp!, updated_at timestamp!",
    _RESTRICTED, ("customer_email",))

STG_CUSTOMERS = struct(
    "customer_id string!, full_name string, email string, phone string, country string,"
    "created_at timestamp, updated_at timestamp", _RESTRICTED, _DIRECT)

PAYLOAD = T.StructType([
    T.StructField("network", T.StringType()), T.StructField("response_code", T.StringType()),
    T.StructField("avs_result", T.StringType()), T.StructField("cvv_result", T.StringType()),
    T.StructField("three_ds", T.StructType([
        T.StructField("version", T.StringType()), T.StructField("authenticated", T.StringType())])),
    T.StructField("network_risk_score", T.StringType()),
    T.StructField("device", T.StructType([
        T.StructField("type", T.StringType()), T.StructField("os", T.StringType())])),
])

FX_RATES = struct("currency string, rate_to_cad rate")

FCT_TRANSACTIONS = struct(
    "transaction_id string!, merchant_id string, customer_id string, card_token string,"
    "customer_email_hash string, amount money, currency string, amount_cad money, status string,"
    "is_approved boolean, entry_mode string, is_card_not_present boolean, ip_country string,"
    "card_network string, response_code string, avs_result string, cvv_result string,"
    "three_ds_authenticated boolean, network_risk_score int, device_type string, refund_count bigint,"
    "refunded_amount total, refunded_amount_cad total, chargeback_count bigint,"
    "has_fraud_chargeback boolean, chargeback_status string, transaction_date date,"
    "created_at timestamp, updated_at timestamp, last_changed_at timestamp",
    {"customer_email_hash": "confidential"})

DIM_MERCHANTS = struct(
    "merchant_id string!, merchant_name string, category string, mcc string, country string,"
    "currency string, card_present boolean, created_at timestamp, valid_from timestamp")

MERCHANT_DAILY_VOLUME = struct(
    "transaction_date date, merchant_id string, merchant_name string, category string, country string,"
    "transaction_count bigint, approved_count bigint, declined_count bigint, decline_rate double,"
    "approved_volume_cad total, refunded_volume_cad total, chargeback_count bigint,"
    "fraud_chargeback_count bigint, card_not_present_share double")

OFFLINE_FEATURES = struct(
    "transaction_id string, card_token string, merchant_id string, event_time timestamp, amount double,"
    "currency string, entry_mode string, is_late boolean, processed_at timestamp,"
    "card_txn_count_5m bigint, card_amount_sum_1h double, seconds_since_last_card_txn double,"
    "is_new_ip_country boolean, merchant_amount_zscore double, fraud_score double, model_version string")

INGEST_RUNS = struct(
    "run_id string, airflow_run_id string, started_at timestamp, finished_at timestamp, status string,"
    "full_refresh boolean, records_read bigint, rows_added bigint, error string")

BUILD_INVOCATIONS = struct(
    "invocation_id string, command string, target string, airflow_run_id string, started_at timestamp,"
    "finished_at timestamp, nodes bigint")

NODE_RUNS = struct(
    "invocation_id string, unique_id string, name string, resource_type string, materialized string,"
    "status string, started_at timestamp, completed_at timestamp, execution_seconds double,"
    "rows_affected bigint, relation_rows bigint, failures bigint, bytes_processed bigint,"
    "bytes_billed bigint, slot_ms bigint, message string")
