"""Service-level indicators, alert rules and rollups over metric samples and logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillwork.functions.scalars import micros, seconds_between
from tillwork.operators.dedupe import latest_with_ties
from tillwork.operators.ordered import Running, nth_row, scan, sliding_sums

# Upper bounds of the reported histograms in seconds, and of the score bins (fixed values).
STREAM_LATENCY_BOUNDS = (0.1, 0.5, 1, 2, 5, 10, 30, 60, 300)
SCORE_BOUNDS = tuple(i / 10 for i in range(1, 11))
# Uptime ranges: total seconds and number of bars (fixed values).
UPTIME_RANGES = {"1h": (3600, 60), "24h": (86400, 48), "7d": (604800, 84)}


def ratio_sli(log: DataFrame, ts: str, good: Column, window: int = 300, step: int = 15) -> DataFrame:
    """Share of good events in the `window` seconds up to each `step` that saw events. Events are
    counted per step first, so the sliding part runs over steps rather than events."""
    at = (F.floor(micros(ts) / (step * 1_000_000)) * step).alias("at")
    steps = log.groupBy(at).agg(F.count(F.lit(1)).alias("n"), F.count_if(good).alias("ok"))
    summed = sliding_sums(steps, [], "at", "at", {"total": (F.col("n"), window - step), "good": (F.col("ok"), window - step)})
    return summed.select("at", "good", "total", (F.col("good") / F.col("total")).alias("ratio"))


def histogram(df: DataFrame, value: str, bounds: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Cumulative bucket counts (le, n) including an infinite bucket, in one pass."""
    counts = [F.count_if(F.col(value) <= float(b)).alias(f"b{i}") for i, b in enumerate(bounds)]
    wide = df.groupBy(*by).agg(*counts, F.count(F.col(value)).alias("all"))
    buckets = [F.struct(F.lit(float(b)).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)]
    buckets.append(F.struct(F.lit(float("inf")).alias("le"), F.col("all").alias("n")))
    return wide.select(*by, F.explode(F.array(*buckets)).alias("b")).select(*by, "b.le", "b.n")


def histogram_quantile(buckets: DataFrame, q: float, by: Sequence[str] = ()) -> DataFrame:
    """Quantile from cumulative buckets (le, n), interpolated inside the bucket it falls into. In
    the infinite bucket it is the largest finite bound. A group holds one row per bound."""
    merged = buckets.groupBy(*by, "le").agg(F.sum("n").alias("n"))
    order = Window.partitionBy(*by).orderBy("le")
    marked = merged.select("*", F.coalesce(F.lag("n").over(order), F.lit(0)).alias("below"),
                           F.lag("le").over(order).alias("previous"),
                           (F.max("n").over(Window.partitionBy(*by)) * q).alias("rank"))
    lower = F.coalesce("previous", F.least(F.lit(0.0), F.col("le")))
    inside = lower + (F.col("le") - lower) * (F.col("rank") - F.col("below")) / (F.col("n") - F.col("below"))
    value = F.when(F.col("le") == float("inf"), F.col("previous")).otherwise(inside)
    hit = (F.col("n") >= F.col("rank")) & ((F.col("below") < F.col("rank")) | F.col("previous").isNull())
    return marked.where(hit).groupBy(*by).agg(F.min_by(value, "le").alias("quantile"))


def latency_histogram(features: DataFrame) -> DataFrame:
    """Event time to availability, clamped at zero."""
    waited = features.where(~F.col("is_late")).select(
        F.greatest(F.lit(0.0), seconds_between("event_time", "processed_at")).alias("seconds"))
    return histogram(waited, "seconds", STREAM_LATENCY_BOUNDS)


def score_distribution(scored: DataFrame) -> DataFrame:
    return histogram(scored, "fraud_score", SCORE_BOUNDS)


def decision_counts(scored: DataFrame) -> DataFrame:
    return scored.groupBy("decision", "feature_source").agg(F.count(F.lit(1)).alias("n"))


# Alert rules over metric samples (at, metric, label, value): name, severity, seconds the condition
# must hold (fixed values).
RULES = {
    "MartDataStale": ("page", 300), "IngestionStalled": ("page", 300), "TransformStalled": ("page", 300),
    "SourceQuiet": ("ticket", 600), "FreshnessCheckFailing": ("ticket", 600),
    "EltErrorBudgetLow": ("ticket", 1800), "EltErrorBudgetBurnFast": ("page", 1800),
    "EltCostSpike": ("ticket", 3600), "EltWriterSaturated": ("ticket", 3600), "ConsumerDown": ("page", 300),
    "ConsumerLagHigh": ("page", 300), "ScorerDown": ("page", 60), "ScorerErrorRate": ("page", 300),
    "ScorerLatencyHigh": ("ticket", 300), "ModelVersionsDiverged": ("ticket", 600),
    "FeatureDrift": ("ticket", 900), "ReviewRateHigh": ("ticket", 900),
}


def evaluate_rules(metrics: DataFrame) -> DataFrame:
    """State of every rule at every sample time: (at, alert, subject, severity, active).

    Two aggregations read the samples: one per time for rules over single series, one per (time,
    label) for rules with a subject. Both combine before the shuffle. A rule whose series is
    absent is inactive, except ScorerDown, which absence also triggers.
    """
    def series(metric, label=None, agg=F.max):
        match = F.col("metric") == metric
        if label is not None:
            match = match & (F.col("label") == label)
        return agg(F.when(match, F.col("value")))

    at_time = metrics.groupBy("at").agg(
        series("freshness_seconds", "mart").alias("mart"), series("freshness_seconds", "raw").alias("raw"),
        series("freshness_seconds", "source").alias("source"), series("cost_usd", "24h").alias("cost_day"),
        series("cost_usd", "7d").alias("cost_week"), series("ledger_age_days").alias("age"),
        series("busy_ratio").alias("busy"), series("consumer_up", agg=F.min).alias("consumer_up"),
        series("consumer_lag", agg=F.sum).alias("lag"), series("scorer_up", agg=F.sum).alias("scorer_up"),
        series("scorer_availability").alias("availability"), series("scorer_p99_seconds").alias("p99"),
        series("model_version").alias("newest"), series("model_version", agg=F.min).alias("oldest"),
        series("review_rate").alias("review"))
    c = F.col
    single = {
        "MartDataStale": c("mart") > 900, "IngestionStalled": c("raw") - c("source") > 900,
        "TransformStalled": c("mart") - c("raw") > 900, "SourceQuiet": c("source") > 900,
        "EltCostSpike": (c("cost_day") > 1.5 * c("cost_week") / 7) & (c("age") >= 7),
        "EltWriterSaturated": c("busy") > 0.7, "ConsumerDown": c("consumer_up") == 0, "ConsumerLagHigh": c("lag") > 1000,
        "ScorerDown": c("scorer_up").isNull() | (c("scorer_up") < 1), "ScorerErrorRate": 1 - c("availability") > 0.001,
        "ScorerLatencyHigh": c("p99") > 0.05, "ModelVersionsDiverged": c("newest") > c("oldest"),
        "ReviewRateHigh": c("review") > 0.05,
    }
    labelled = metrics.where(F.col("metric").isin("check_success", "budget_left", "slo_sli_24h", "slo_objective",
                                                  "feature_psi")).groupBy("at", "label").agg(
        series("check_success", agg=F.min).alias("check"), series("budget_left", agg=F.min).alias("budget"),
        series("slo_sli_24h", agg=F.min).alias("sli"), series("slo_objective").alias("objective"),
        series("feature_psi").alias("psi"))
    subject = {
        "FreshnessCheckFailing": c("check") == 0, "EltErrorBudgetLow": c("budget") < 0.25,
        "EltErrorBudgetBurnFast": (1 - c("sli")) > 15 * (1 - c("objective")), "FeatureDrift": c("psi") > 0.25,
    }

    def states(df, rules, label, known=None):
        rows = F.array(*[F.struct(F.lit(n).alias("alert"), F.lit(RULES[n][0]).alias("severity"),
                                  (F.coalesce(e, F.lit(False)) if known is None else e).alias("active"))
                         for n, e in rules.items()])
        return df.select("at", label.alias("subject"), F.explode(rows).alias("r")).select(
            "at", "r.alert", "subject", "r.severity", "r.active").where("active is not null")

    return states(at_time, single, F.lit(None).cast("string")).unionByName(
        states(labelled, subject, F.col("label"), known=True))


def sustained(states: DataFrame) -> DataFrame:
    """inactive, pending or firing at each sample, by how long the rule has been active."""
    key = ["alert", "subject"]
    hold = F.coalesce(*[F.when(F.col("alert") == n, F.lit(s)) for n, (_, s) in RULES.items()])
    timed = states.withColumn("_at", micros("at"))
    before = scan(timed, key, ["_at"], [Running("_was", "prev", F.col("active"))])
    began = F.when(F.col("active") & ~F.coalesce("_was", F.lit(False)), F.col("_at"))
    runs = scan(before, key, ["_at"], [Running("_since", "max", began)])
    held = (F.col("_at") - F.col("_since")) / 1_000_000
    state = F.when(~F.col("active"), "inactive").when(held >= hold, "firing").otherwise("pending")
    return runs.select("at", *key, "severity", "active", state.alias("state"))


def alert_list(alerts: DataFrame) -> DataFrame:
    """Alerts that are not inactive at the newest sample, firing first, then by name."""
    newest = alerts.agg(F.max("at").alias("at"))
    return (alerts.where("state <> 'inactive'").join(F.broadcast(newest), "at", "left_semi")
            .orderBy(F.col("state") != "firing", "alert", "subject"))


def uptime_current(checks: DataFrame) -> DataFrame:
    """Latest check per service; checks at the same second are all kept."""
    return latest_with_ties(checks, ["service"], "ts").select("service", "ts", "up", "latency_ms", "error")


def uptime_history(checks: DataFrame, end: int, seconds: int, bars: int) -> DataFrame:
    """One row per service and bar: checks, checks up, an error if any was down, and uptime;
    a bar without checks has nulls."""
    width, start = seconds // bars, end - seconds
    seen = checks.where(F.col("ts") >= start)
    bar = F.floor((F.col("ts") - start) / width).cast("int")
    counted = (seen.groupBy("service", bar.alias("bar")).agg(
        F.count(F.lit(1)).alias("checks"), F.sum("up").alias("up"), F.max(F.when(F.col("up") == 0, F.col("error"))).alias("error"))
        .withColumn("uptime", F.col("up") / F.col("checks")))
    spine = seen.select("service").distinct().select("service", F.explode(F.sequence(F.lit(0), F.lit(bars - 1))).alias("bar"))
    return spine.join(counted, ["service", "bar"], "left")


def uptime_total(history: DataFrame) -> DataFrame:
    return history.groupBy("service").agg(
        F.sum("checks").alias("checks"), F.sum("up").alias("up"), (F.sum("up") / F.sum("checks")).alias("uptime"))


def request_summary(log: DataFrame) -> DataFrame:
    """Requests, failures and latency percentiles of a request log (status, latency_ms, detail).
    The percentiles are the values at sorted positions n/2 and 0.99 n."""
    totals = log.agg(F.count(F.lit(1)).alias("requests"), F.count_if(F.col("status") == "ok").alias("ok")).first()
    good = log.where("status = 'ok'").select("latency_ms")

    def at(position):
        return nth_row(good, ["latency_ms"], position + 1)[0] if totals["ok"] else 0.0

    failed = totals["requests"] - totals["ok"]
    row = (totals["requests"], totals["ok"], failed, failed / max(1, totals["requests"]),
           float(at(totals["ok"] // 2)), float(at(int(totals["ok"] * 0.99))))
    return log.sparkSession.createDataFrame(
        [row], "requests bigint, ok bigint, failed bigint, failed_share double, p50_ms double, p99_ms double")


def request_breakdown(log: DataFrame) -> DataFrame:
    """Requests by outcome and by model version or error text."""
    return log.groupBy("status", "detail").agg(F.count(F.lit(1)).alias("n"))
