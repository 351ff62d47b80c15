"""Marts, checks, features and drift on small cases."""

import math
from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tillwork.functions import scalars
from tillwork.operators import drift, quality
from tillwork.operators.upsert import scd2_merge, upsert
from tillwork.plans import features, marts, scoring
from tillwork.schemas import FCT_TRANSACTIONS, FX_RATES
from tillwork.sources import mapping

T0, T1, T2 = datetime(2026, 1, 1), datetime(2026, 1, 2), datetime(2026, 1, 3)


def test_adjustments_cover_both_sides(spark):
    refunds = spark.createDataFrame([("a", Decimal("1.50"), T1), ("a", Decimal("2.00"), T0), ("b", Decimal("3.00"), T0)],
                                    "transaction_id string, amount decimal(18,2), updated_at timestamp")
    chargebacks = spark.createDataFrame(
        [("a", Decimal("9.00"), False, "lost", T2), ("a", Decimal("1.00"), True, "open", T0), ("c", Decimal("4.00"), False, "won", T0)],
        "transaction_id string, amount decimal(18,2), is_fraud boolean, chargeback_status string, updated_at timestamp")
    got = {r["transaction_id"]: r for r in marts.transaction_adjustments(refunds, chargebacks).collect()}
    assert set(got) == {"a", "b", "c"}
    a = got["a"]
    assert (a["refund_count"], a["refunded_amount"], a["chargeback_count"], a["has_fraud_chargeback"], a["chargeback_status"],
            a["updated_at"]) == (2, Decimal("3.50"), 2, True, "open", T2)
    assert (got["b"]["chargeback_count"], got["b"]["chargeback_status"], got["c"]["refund_count"]) == (0, None, 0)


def test_half_cents_and_unknown_currency(spark):
    df = spark.createDataFrame([(Decimal("0.50"), "USD"), (Decimal("1.00"), "XXX")], "amount decimal(18,2), currency string")
    out = df.join(mapping.fx_rates(spark), "currency", "left").select(
        scalars.to_cad(F.col("amount"), F.col("rate_to_cad")).alias("cad")).collect()
    assert sorted((r["cad"] for r in out), key=str) == [Decimal("0.69"), None]   # 0.685 rounds up
    assert mapping.fx_rates(spark).schema.simpleString() == FX_RATES.simpleString()


def test_upsert_appends_columns(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    new = spark.createDataFrame([(2, "c", 9), (3, "d", 8)], "id int, v string, extra int")
    assert sorted(map(tuple, upsert(old, new, ["id"]).collect())) == [(1, "a", None), (2, "c", 9), (3, "d", 8)]


def test_scd2_keeps_unchanged_and_closes_changed(spark):
    history = spark.createDataFrame([("m1", "x", T0, None), ("m2", "y", T0, None), ("m3", "z", T0, None)],
                                    "id string, name string, valid_from timestamp, valid_to timestamp")
    now = spark.createDataFrame([("m1", "x", T0), ("m2", "y2", T1), ("m4", "n", T1)], "id string, name string, updated_at timestamp")
    got = sorted(map(tuple, scd2_merge(history, now, "id", "updated_at").collect()), key=str)
    assert got == sorted([("m1", "x", T0, None), ("m2", "y", T0, T1), ("m2", "y2", T1, None), ("m3", "z", T0, None),
                          ("m4", "n", T1, None)], key=str)
    again = scd2_merge(spark.createDataFrame(got, history.schema), now, "id", "updated_at")
    assert sorted(map(tuple, again.collect()), key=str) == got


CONTRACT = ({"name": "id", "type": "bigint", "nullable": False}, {"name": "amount", "type": "numeric(18,2)", "nullable": False},
            {"name": "note", "type": "text", "nullable": True})


def test_contract_differences(spark):
    good = spark.createDataFrame([(1, Decimal("1.00"), "x")], "id bigint, amount decimal(18,2), note string")
    assert quality.contract(good, CONTRACT).count() == 0
    bad = spark.createDataFrame([("1", None, 5)], "id string, amount decimal(18,2), extra int")
    got = {(r["severity"], r["column_name"]): r["finding"] for r in quality.contract(bad, CONTRACT).collect()}
    assert set(got) == {("breaking", "id"), ("breaking", "amount"), ("breaking", "note"), ("warning", "extra")}
    assert quality.contract(None, CONTRACT).first()["severity"] == "breaking"
    assert quality.type_name("timestamp with time zone") == "timestamp" and quality.type_name("numeric(18, 2)") == "decimal(18,2)"


def test_enforce_fails_on_a_missing_column(spark):
    with pytest.raises(ValueError, match="missing"):
        quality.enforce(spark.range(1), FCT_TRANSACTIONS)


def test_over_refund(spark):
    df = spark.createDataFrame([("a", Decimal("5.00"), Decimal("6.00"), 1), ("b", Decimal("5.00"), Decimal("5.00"), 1)],
                               "transaction_id string, amount decimal(18,2), refunded_amount decimal(38,2), refund_count long")
    assert [r[0] for r in quality.over_refunds(df).collect()] == ["a"]


def test_volume_anomaly_excludes_today(spark):
    days = [(date(2026, 1, d),) for d in range(1, 21) for _ in range(10 + d % 2)] + [(date(2026, 1, 21),)] * 200
    days += [(date(2026, 1, 22),)]
    found = quality.volume_anomaly(spark.createDataFrame(days, "d date"), "d", date(2026, 1, 22)).collect()
    assert [(r["day"], r["row_count"]) for r in found] == [(date(2026, 1, 21), 200)]


def test_bucket_shares_are_upper_inclusive(spark):
    values = spark.createDataFrame([("f", float(v)) for v in range(100)] + [("g", 1.0)] * 10, "feature string, v double")
    edges = spark.createDataFrame([("f", [24.5, 49.5, 74.5]), ("g", [5.0, 10.0])], "feature string, edges array<double>")
    got = {(r["feature"], r["bucket"]): r["share"] for r in drift.bucket_shares(values, edges).collect()}
    assert [got["f", i] for i in range(4)] == [0.25] * 4
    assert [got["g", i] for i in range(3)] == [1.0, 0.0, 0.0]


def test_psi_needs_enough_rows_and_is_zero_on_itself(spark):
    df = spark.range(500).select(*[(F.col("id") % (i + 7)).cast("double").alias(f) for i, f in enumerate(drift.DRIFT_FEATURES)])
    assert drift.psi(df, df.limit(50)).count() == 0
    assert {r["psi"] for r in drift.psi(df, df).collect()} == {0.0}


def test_skew_report_on_itself_matches_fully(spark):
    rows = spark.range(50).select(F.col("id").alias("transaction_id"), F.lit(1).alias("card_txn_count_5m"),
                                  (F.col("id") * 1.5).alias("card_amount_sum_1h"),
                                  F.when(F.col("id") % 2 == 0, 3.0).alias("seconds_since_last_card_txn"),
                                  F.lit(False).alias("is_new_ip_country"), F.lit(0.5).alias("merchant_amount_zscore"))
    online = rows.withColumns({"is_late": F.lit(False), "processed_at": F.lit(T0)})
    report = drift.skew_report(online, rows)
    assert {r["match_rate"] for r in report.collect()} == {1.0}
    assert drift.skew_gate(report, 1.0)


def vector(spark, **fields):
    event = {"amount": Decimal("100.00"), "currency": "USD", "entry_mode": "ecommerce", "avs_result": None, "cvv_result": None,
             "three_ds_authenticated": None, "network_risk_score": None, "card_txn_count_5m": 3, "card_amount_sum_1h": 250.0,
             "seconds_since_last_card_txn": None, "is_new_ip_country": True, "merchant_amount_zscore": 1.5, **fields}
    schema = ("amount decimal(18,2), currency string, entry_mode string, avs_result string, cvv_result string,"
              "three_ds_authenticated string, network_risk_score string, card_txn_count_5m long, card_amount_sum_1h double,"
              "seconds_since_last_card_txn double, is_new_ip_country boolean, merchant_amount_zscore double")
    df = spark.createDataFrame([tuple(event.values())], schema)
    return features.feature_vector(df, mapping.fx_rates(spark)).select(*features.FEATURES).first().asDict()


def test_feature_vector(spark):
    v = vector(spark, avs_result="Z", cvv_result="N", three_ds_authenticated="true", network_risk_score="70")
    assert v["amount_cad"] == 137.0 and v["avs_mismatch"] == v["cvv_mismatch"] == v["is_card_not_present"] == 1.0
    assert math.isnan(v["seconds_since_last_card_txn"]) and v["is_new_ip_country"] == 1.0
    assert v["three_ds_authenticated"] == 1.0 and v["network_risk_score"] == 70.0
    chip = vector(spark, entry_mode="chip", currency="CAD")
    assert chip["is_card_not_present"] == chip["avs_mismatch"] == 0.0 and math.isnan(chip["three_ds_authenticated"])


def test_zscore_of_equal_amounts_is_zero(spark):
    df = spark.range(40).select(F.lit("m").alias("merchant_id"), F.col("id").alias("transaction_id"), F.col("id").alias("_at"),
                                F.lit(Decimal("0.10")).cast("decimal(18,2)").alias("amount"))
    assert {r[0] for r in features.merchant_zscore(df).select("merchant_amount_zscore").collect()} == {0.0}


def test_evaluate_by_hand(spark):
    rows = [(1, 0.9, 1), (2, 0.8, 0), (3, 0.8, 1), (4, 0.1, 0)]
    got = scoring.evaluate(spark.createDataFrame(rows, "transaction_id long, score double, label int")).first()
    assert got["pr_auc"] == pytest.approx(0.5 * 1 + 0.5 * 2 / 3)
    assert got["roc_auc"] == pytest.approx((2 + 1.5) / 4)
    assert (got["threshold_at_1pct"], got["precision_at_1pct"], got["recall_at_1pct"]) == (0.9, 1.0, 0.5)
    assert scoring.compare_models(spark.createDataFrame(rows, "transaction_id long, score double, label int"), None).first()["promote"]


def test_features_agree_with_history_after_incremental_reads(spark):
    assert scalars.instant(T0) is not None
    df = spark.createDataFrame([(1, " A@B.com ")], "id int, mail string")
    assert df.select(scalars.mask_email("mail")).first()[0] == df.select(F.md5(F.lit("a@b.com"))).first()[0]
    assert len(df.select(scalars.mask_email("mail", "key")).first()[0]) == 64


def test_zscore_of_amounts_of_any_size(spark, split):
    """Sums of squares of forty digits and more, and nearly equal large amounts."""
    import statistics
    from decimal import Decimal

    near = [Decimal("2000000000.00") + Decimal(i % 3) / 100 for i in range(80)]
    huge = [Decimal("9999999999999999.99") - (i % 5) * Decimal("1234567890123456.78") for i in range(80)]
    rows = [(m, i, f"{i:03d}", a) for m, amounts in (("near", near), ("huge", huge)) for i, a in enumerate(amounts)]
    df = spark.createDataFrame(rows, "merchant_id string, _at long, transaction_id string, amount decimal(18,2)")
    got = {(r["merchant_id"], r["_at"]): r["merchant_amount_zscore"] for r in features.merchant_zscore(df).collect()}
    for m, amounts in (("near", near), ("huge", huge)):
        for i in range(30, 80):
            before = amounts[:i]
            want = float((amounts[i] - statistics.mean(before)) / statistics.stdev(before))
            assert got[m, i] == pytest.approx(want, rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("sent", [0, 1_000_000])
def test_upsert_of_unique_changes(spark, monkeypatch, sent):
    """Replaced keys sent whole or joined, null keys kept."""
    from tillwork.operators import upsert as merging

    monkeypatch.setattr(merging, "KEYS_SENT", sent)
    old = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "id int, v string")
    new = spark.createDataFrame([(2, "c", 9), (3, "d", 8), (None, "m", 7)], "id int, v string, extra int")
    got = sorted(map(tuple, merging.upsert(old, new, ["id"], unique=True).collect()), key=str)
    assert got == sorted([(1, "a", None), (None, "n", None), (2, "c", 9), (3, "d", 8), (None, "m", 7)], key=str)
    assert got == sorted(map(tuple, merging.upsert(old, new, ["id"]).collect()), key=str)


def test_adjustments_by_a_coarser_column(spark):
    """Looked up by the map of a group as by a join, also with a null id and a group without adjustments."""
    txns = spark.createDataFrame([(1, "1-1"), (1, "1-2"), (2, "2-1"), (3, None)], "g long, transaction_id string")
    adj = spark.createDataFrame([(1, "1-2", 3, None), (2, "2-9", 4, "x"), (3, None, 5, "y")], "g long, transaction_id string, n long, s string")
    got = sorted(map(tuple, marts._looked_up(txns, adj, "g").collect()), key=str)
    want = sorted(map(tuple, txns.join(adj.drop("g"), "transaction_id", "left").select("g", "transaction_id", "n", "s").collect()), key=str)
    assert got == want
