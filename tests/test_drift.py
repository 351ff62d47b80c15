"""The drift report's choice of rows and its way into the alert rules."""

from datetime import datetime

from pyspark.sql import functions as F

from tillwork.operators import drift
from tillwork.plans.monitoring import evaluate_rules

SINCE = datetime(2026, 1, 2)


def rows(spark, n, amount="id", day=2):
    return spark.range(n).select(
        F.expr(amount).cast("double").alias("amount"), F.lit(1).alias("card_txn_count_5m"), F.lit(2.0).alias("card_amount_sum_1h"),
        F.lit(None).cast("double").alias("seconds_since_last_card_txn"), F.lit(0.0).alias("merchant_amount_zscore"),
        F.lit(True).alias("label_mature"), F.lit(True).alias("is_approved"), F.lit(False).alias("is_late"),
        F.lit(datetime(2026, 1, day)).alias("processed_at"))


def report(reference, live):
    return {r["feature"]: (r["live_rows"], r["psi"]) for r in drift.drift_report(reference, live, SINCE).collect()}


def test_late_old_immature_and_declined_rows_do_not_count(spark):
    good = rows(spark, 200)
    far = rows(spark, 300, "id + 1000")
    same = report(good.unionByName(far.withColumn("label_mature", F.lit(False))).unionByName(far.withColumn("is_approved", F.lit(False))),
                  good.unionByName(far.withColumn("is_late", F.lit(True))).unionByName(rows(spark, 300, "id + 1000", day=1)))
    assert same == {f: (200, 0.0) for f in drift.DRIFT_FEATURES}


def test_a_shift_raises_the_alert(spark):
    found = drift.drift_report(rows(spark, 200), rows(spark, 200, "id + 1000"), SINCE)
    states = evaluate_rules(drift.drift_samples(found, datetime(2026, 1, 2))).where("alert = 'FeatureDrift'")
    assert {r["subject"]: r["active"] for r in states.collect()} == {f: f == "amount" for f in drift.DRIFT_FEATURES}


def test_too_few_rows_and_no_training_rows_give_no_index(spark):
    assert report(rows(spark, 200), rows(spark, 99)) == {f: (99, None) for f in drift.DRIFT_FEATURES}
    assert report(rows(spark, 0), rows(spark, 150)) == {f: (150, None) for f in drift.DRIFT_FEATURES}
    empty = drift.drift_samples(drift.drift_report(rows(spark, 200), rows(spark, 0), SINCE), datetime(2026, 1, 2))
    assert empty.count() == 0
