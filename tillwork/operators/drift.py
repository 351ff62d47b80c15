"""Distribution comparisons: decile edges, bucket shares, population stability, feature skew."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwork.functions.scalars import drift_value
from tillwork.operators.dedupe import latest_by
from tillwork.operators.ordered import exact_quantiles, quantiles_of_counts, value_counts

# Features compared, absolute tolerances for "agrees", and the least rows for a stable estimate
# (fixed values).
DRIFT_FEATURES = ("amount", "card_txn_count_5m", "card_amount_sum_1h", "seconds_since_last_card_txn",
                  "merchant_amount_zscore")
TOLERANCE = {"card_txn_count_5m": 0.0, "card_amount_sum_1h": 0.01, "seconds_since_last_card_txn": 1.0,
             "is_new_ip_country": 0.0, "merchant_amount_zscore": 0.01}
DECILES = tuple(i / 10 for i in range(1, 10))
MIN_ROWS = 100


def long_features(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature, v) rows with missing as -1. Callers aggregate at once, so the longer table is
    combined before it is shuffled."""
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), drift_value(f).alias("v")) for f in features])
    return df.select(F.explode(pairs).alias("p")).select("p.feature", "p.v")


def decile_edges(df: DataFrame, features: Sequence[str] = DRIFT_FEATURES) -> DataFrame:
    """Distinct ascending decile edges per feature, as (feature, edges)."""
    quantiles = exact_quantiles(long_features(df, features), "v", DECILES, ["feature"])
    return quantiles.select("feature", F.array_sort(F.array_distinct("quantiles")).alias("edges"))


def bucket_shares(values: DataFrame, edges: DataFrame) -> DataFrame:
    """Share of (feature, v) rows in each bucket (-inf, e0], (e0, e1], ..., (en, inf); empty
    buckets are 0. `edges` holds one short array per feature."""
    edges = F.broadcast(edges.select("feature", "edges"))
    counted = values.groupBy("feature", "v").agg(F.count(F.lit(1)).alias("n"))
    bucket = F.size(F.filter("edges", lambda e: e < F.col("v")))
    filled = counted.join(edges, "feature").groupBy("feature", bucket.alias("bucket")).agg(F.sum("n").alias("n"))
    spine = edges.select("feature", F.explode(F.sequence(F.lit(0), F.size("edges"))).alias("bucket"))
    # The rest runs over one row per bucket.
    full = spine.join(filled, ["feature", "bucket"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    totals = full.groupBy("feature").agg(F.sum("n").alias("total"))
    return full.join(totals, "feature").select(
        "feature", "bucket", (F.col("n") / F.greatest("total", F.lit(1))).alias("share"))


def stability_index(actual: Column, expected: Column) -> Column:
    small = F.lit(1e-4)
    return F.round(F.sum((actual - expected) * F.ln((actual + small) / (expected + small))), 4)


def psi(reference: DataFrame, live: DataFrame, features: Sequence[str] = DRIFT_FEATURES,
        edges: DataFrame | None = None) -> DataFrame:
    """Population stability index per feature of `live` against `reference`; no rows when there
    are too few live ones. The edges can be kept from an earlier run."""
    if live.limit(MIN_ROWS).count() < MIN_ROWS:
        return live.sparkSession.createDataFrame([], "feature string, psi double")
    edges = decile_edges(reference, features) if edges is None else edges
    # At most nine edges for each feature: fixed here so that the quantiles are computed once.
    edges = live.sparkSession.createDataFrame(edges.collect(), edges.schema)
    expected = bucket_shares(long_features(reference, features), edges).withColumnRenamed("share", "expected")
    actual = bucket_shares(long_features(live, features), edges).withColumnRenamed("share", "actual")
    return (expected.join(actual, ["feature", "bucket"]).groupBy("feature")
            .agg(stability_index(F.col("actual"), F.col("expected")).alias("psi")))


def drift_report(reference: DataFrame, live: DataFrame, since, features: Sequence[str] = DRIFT_FEATURES) -> DataFrame:
    """Stability of the features streamed from `since` on against the mature, approved training rows, as
    (feature, live_rows, psi): one row for every feature, its psi null while fewer than MIN_ROWS on-time
    rows, or no training rows, are there. Late rows carry no features and are left out."""
    recent = on_time(live, since)
    found = psi(reference.where(F.col("label_mature") & F.col("is_approved")), recent, features)
    names = live.sparkSession.createDataFrame([(f,) for f in features], "feature string")
    return names.join(found, "feature", "left").select("feature", F.lit(recent.count()).alias("live_rows"), "psi")


def drift_samples(report: DataFrame, at) -> DataFrame:
    """The report as metric samples for the alert rules; features without an index give none."""
    return report.where(F.col("psi").isNotNull()).select(
        F.lit(at).alias("at"), F.lit("feature_psi").alias("metric"), F.col("feature").alias("label"), F.col("psi").alias("value"))


def on_time(online: DataFrame, since=None) -> DataFrame:
    """On-time streamed rows, with `since` those processed from then on."""
    kept = online.where(~F.col("is_late"))
    return kept if since is None else kept.where(F.col("processed_at") >= since)


def first_processed(online: DataFrame, since=None) -> DataFrame:
    """On-time streamed rows, one per transaction: the first one processed."""
    return latest_by(on_time(online, since), ["transaction_id"], [F.col("processed_at").asc()])


def skew_report(online: DataFrame, offline: DataFrame, since=None,
                tolerances: dict[str, float] = TOLERANCE) -> DataFrame:
    """Agreement of streamed and batch features: match rate, median and largest difference. A
    null difference counts as no match; the gap feature compares missing as -1."""
    on = first_processed(online, since).select("transaction_id", *[F.col(f).alias(f"o_{f}") for f in tolerances])
    off = offline.select("transaction_id", *[F.col(f).alias(f"f_{f}") for f in tolerances])

    def side(prefix, f):
        value = F.col(f"{prefix}_{f}").cast("double")
        return F.coalesce(value, F.lit(-1.0)) if f == "seconds_since_last_card_txn" else value

    diffs = F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(t).alias("tolerance"),
                               F.abs(side("o", f) - side("f", f)).alias("diff")) for f, t in tolerances.items()])
    both = on.join(off, "transaction_id").select(F.explode(diffs).alias("d")).select("d.*")
    # Equal differences are merged before anything else, so a feature that agrees is one row.
    counted = value_counts(both, "diff", ["feature", "tolerance"])
    matched = F.sum(F.when(F.col("diff") <= F.col("tolerance"), F.col("n")).otherwise(0))
    rates = counted.groupBy("feature").agg((matched / F.sum("n")).alias("match_rate"), F.max("diff").alias("max_diff"))
    middle = quantiles_of_counts(counted, "diff", [0.5], ["feature"]).select(
        "feature", F.col("quantiles")[0].alias("median_diff"))
    return rates.join(middle, "feature", "left").select("feature", "match_rate", "median_diff", "max_diff")


def skew_gate(report: DataFrame, min_match: float) -> bool:
    worst = report.agg(F.min("match_rate")).first()[0]
    return worst is not None and worst >= min_match
