"""Cost, reliability and efficiency of the pipeline, from its run ledger.

Ledger tables: ingest_runs, build_invocations and node_runs (schemas.py). A table that does not
exist yet is passed as None and counts as empty.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwork.functions.scalars import instant, micros, seconds_between
from tillwork.operators.ordered import Running, asof_left, scan

# Reporting windows in days, list prices and service-level targets (fixed values).
WINDOWS = {"24h": 1, "7d": 7, "30d": 30}
COMPUTE_USD_PER_HOUR = 0.134
USD_PER_TIB = 6.25
OBJECTIVES = {"elt_step_success": 0.99, "ingest_duration": 0.95, "mart_delivery": 0.99}
INGEST_TARGET_SECONDS = 300
DELIVERY_TARGET_SECONDS = 900
BUILD_TYPES = ("model", "seed", "snapshot")
TEST_TYPES = ("test", "unit_test")
FACT = "fct_transactions"


@dataclass(frozen=True)
class Ledger:
    ingest_runs: DataFrame | None
    invocations: DataFrame | None
    node_runs: DataFrame | None

    @property
    def has_builds(self) -> bool:
        return self.invocations is not None and self.node_runs is not None


def rows_written() -> Column:
    """Rows a node wrote: as reported, or all of the relation when it was rebuilt in full."""
    return F.coalesce("rows_affected", F.when(F.col("materialized") == "table", F.col("relation_rows")))


def _seconds() -> Column:
    return seconds_between("started_at", "finished_at")


def is_build() -> Column:
    return F.col("resource_type").isin(*BUILD_TYPES)


def is_test() -> Column:
    return F.col("resource_type").isin(*TEST_TYPES)


def _unpivot(totals: DataFrame, measures: dict[str, Column]) -> DataFrame:
    rows = [F.struct(F.lit(w).alias("window"), *[F.col(f"{m}_{w}").cast("double").alias(m) for m in measures])
            for w in WINDOWS]
    return totals.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def _per_window(df: DataFrame, now: datetime, measures: dict[str, Column]) -> DataFrame:
    """One pass over a ledger table for all windows. Each measure is a value to sum; only rows of
    the longest window are read, and the shorter ones are conditions inside the aggregates."""
    since = {w: instant(now - timedelta(days=d)) for w, d in WINDOWS.items()}
    longest = max(WINDOWS, key=WINDOWS.get)
    sums = [F.coalesce(F.sum(F.when(F.col("started_at") >= since[w], value)), F.lit(0)).alias(f"{m}_{w}")
            for m, value in measures.items() for w in WINDOWS]
    return _unpivot(df.where(F.col("started_at") >= since[longest]).agg(*sums), measures)


def _one(condition: Column) -> Column:
    return F.when(condition, 1).otherwise(0)


def elt_windows(ledger: Ledger, now: datetime) -> DataFrame:
    """Totals per window: sync runs, seconds and records; builds, tests, rows and bytes."""
    ok = F.col("status") == "success"
    seconds = _seconds().cast("decimal(28,6)")
    ingest = {"ingest_runs": F.lit(1), "ingest_ok": _one(ok),
              "ingest_fast": _one(ok & (_seconds() <= INGEST_TARGET_SECONDS)),
              "ingest_seconds": seconds, "records": F.col("records_read")}
    ran = F.col("status") != "skipped"
    nodes = {"builds": _one(is_build() & ran), "builds_ok": _one(is_build() & ok), "tests": _one(is_test() & ran),
             "tests_ok": _one(is_test() & (F.col("status") == "pass")),
             "node_seconds": F.col("execution_seconds").cast("decimal(28,6)"), "rows_written": rows_written(),
             "bytes_billed": F.col("bytes_billed")}
    builds = {"build_seconds": seconds}
    names = [*ingest, *builds, *nodes]
    parts = []
    if ledger.ingest_runs is not None:
        parts.append(_per_window(ledger.ingest_runs, now, ingest))
    if ledger.has_builds:
        parts.append(_per_window(ledger.invocations, now, builds))
        owned = ledger.node_runs.drop("started_at").join(
            ledger.invocations.select("invocation_id", "started_at"), "invocation_id")
        parts.append(_per_window(owned, now, nodes))
    if not parts:
        raise ValueError("no ledger table given")
    out = parts[0]
    for part in parts[1:]:
        out = out.join(F.broadcast(part), "window")   # one row per window
    return out.select("window", *[F.col(n) if n in out.columns else F.lit(0.0).alias(n) for n in names])


def delivery_sli(node_runs: DataFrame, now: datetime) -> DataFrame:
    """Share of minutes with a successful fact build in the 15 minutes before, per window. The
    minutes start at the first recorded build when that is later than the window's start."""
    built = node_runs.where((F.col("name") == FACT) & (F.col("resource_type") == "model")
                            & (F.col("status") == "success")).select("completed_at")
    starts = F.array(*[F.struct(F.lit(w).alias("window"), instant(now - timedelta(days=d)).alias("since"))
                       for w, d in WINDOWS.items()])
    end = instant(now)
    minutes = (built.agg(F.min("completed_at").alias("first")).where("first is not null")
               .select("first", F.explode(starts).alias("w"))
               .select(F.col("w.window").alias("window"), F.greatest("w.since", "first").alias("begin"))
               .where(F.col("begin") < end)
               .select("window", F.explode(F.sequence("begin", end - F.expr("interval 1 microsecond"),
                                                      F.expr("interval 1 minute"))).alias("t")))
    seen = asof_left(minutes, built.select(F.col("completed_at").alias("at"), F.col("completed_at").alias("built")),
                     "t", "at", ["built"])
    fresh = F.col("built") >= F.col("t") - F.expr(f"interval {DELIVERY_TARGET_SECONDS} second")
    return seen.groupBy("window").agg(F.avg(F.when(fresh, 1.0).otherwise(0.0)).alias("sli"))


def slis(ledger: Ledger, now: datetime) -> DataFrame:
    """(slo, window, sli); an indicator without events is left out."""
    totals = elt_windows(ledger, now)
    steps = F.struct(F.lit("elt_step_success").alias("slo"), (
        (F.col("ingest_ok") + F.col("builds_ok")) / F.nullif(F.col("ingest_runs") + F.col("builds"), F.lit(0.0))
    ).alias("sli"))
    fast = F.struct(F.lit("ingest_duration").alias("slo"),
                    (F.col("ingest_fast") / F.nullif(F.col("ingest_ok"), F.lit(0.0))).alias("sli"))
    out = totals.select("window", F.explode(F.array(steps, fast)).alias("s")).select("s.slo", "window", "s.sli")
    if ledger.node_runs is not None:
        out = out.unionByName(delivery_sli(ledger.node_runs, now).select(
            F.lit("mart_delivery").alias("slo"), "window", "sli"))
    return out.where("sli is not null")


def error_budget_left(sli: Column, objective: Column) -> Column:
    """1 is untouched, 0 spent, negative overspent."""
    return 1 - (1 - sli) / (1 - objective)


def error_budgets(sli_rows: DataFrame) -> DataFrame:
    objective = F.coalesce(*[F.when(F.col("slo") == s, F.lit(o)) for s, o in OBJECTIVES.items()])
    return (sli_rows.where("window = '30d'").withColumn("objective", objective)
            .select("slo", "sli", "objective", error_budget_left(F.col("sli"), F.col("objective")).alias("budget_left")))


def estimated_cost(seconds: Column, bytes_billed: Column) -> Column:
    return seconds / 3600 * COMPUTE_USD_PER_HOUR + bytes_billed / float(2 ** 40) * USD_PER_TIB


def elt_cost(totals: DataFrame) -> DataFrame:
    cost = estimated_cost(F.col("ingest_seconds") + F.col("build_seconds"), F.col("bytes_billed"))
    return totals.select("window", cost.alias("cost_usd"),
                         (cost / F.nullif(F.col("records"), F.lit(0.0)) * 1e6).alias("usd_per_million_records"))


def elt_efficiency(totals: DataFrame) -> DataFrame:
    """Busy share of the writer, build overhead, write amplification and test pass rate of a day."""
    def ratio(a, b):
        return F.col(a) / F.nullif(F.col(b), F.lit(0.0))

    return totals.where("window = '24h'").select(
        ((F.col("ingest_seconds") + F.col("build_seconds")) / 86400).alias("busy_ratio"),
        F.when(F.col("build_seconds") != 0, F.greatest(F.lit(0.0), 1 - ratio("node_seconds", "build_seconds")))
        .alias("overhead_ratio"),
        ratio("rows_written", "records").alias("write_amplification"),
        ratio("tests_ok", "tests").alias("test_pass_ratio"))


def _owned(ledger: Ledger, since) -> DataFrame:
    runs = ledger.invocations.where(F.col("started_at") >= since)
    return ledger.node_runs.drop("started_at").join(runs.select("invocation_id", "started_at"), "invocation_id")


def node_totals(ledger: Ledger, now: datetime) -> DataFrame:
    """Seconds, rows and bytes per built node over the last day."""
    return (_owned(ledger, instant(now - timedelta(days=1))).where(is_build())
            .groupBy("name", "resource_type").agg(
                F.sum("execution_seconds").cast("double").alias("seconds"),
                F.sum(rows_written()).alias("rows_written"), F.sum("bytes_billed").alias("bytes_billed")))


def last_runs(ledger: Ledger) -> DataFrame:
    """When each step last finished and whether it succeeded; a build succeeds if no node failed."""
    parts = []
    if ledger.has_builds:
        last = ledger.invocations.orderBy(F.col("finished_at").desc(), "invocation_id").limit(1)
        broken = (ledger.node_runs.where(F.col("status").isin("error", "fail"))
                  .join(F.broadcast(last.select("invocation_id")), "invocation_id", "left_semi")
                  .select("invocation_id", F.lit(True).alias("broken")).distinct())
        parts.append(last.join(broken, "invocation_id", "left").select(
            F.lit("build").alias("step"), "finished_at", F.col("broken").isNull().alias("succeeded")))
    if ledger.ingest_runs is not None:
        last = ledger.ingest_runs.orderBy(F.col("finished_at").desc(), "run_id").limit(1)
        parts.append(last.select(F.lit("ingest").alias("step"), "finished_at",
                                 (F.col("status") == "success").alias("succeeded")))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def ledger_age(ledger: Ledger, now: datetime) -> DataFrame:
    firsts = None
    for table in (ledger.ingest_runs, ledger.invocations):
        if table is not None:
            first = table.agg(F.min("started_at").alias("first"))
            firsts = first if firsts is None else firsts.unionAll(first)
    return firsts.agg(F.coalesce(seconds_between(F.min("first"), instant(now)) / 86400, F.lit(0.0)).alias("age_days"))


def layer_freshness(layers: dict[str, tuple[DataFrame, str]], now: datetime) -> DataFrame:
    """Age of the newest data per layer."""
    out = None
    for name, (df, ts) in layers.items():
        age = df.agg(F.max(ts).alias("newest")).select(
            F.lit(name).alias("layer"), seconds_between("newest", instant(now)).alias("age_seconds"))
        out = age if out is None else out.unionAll(age)
    return out


def failed_steps(ledger: Ledger, now: datetime, days: int = 1) -> DataFrame:
    since = instant(now - timedelta(days=days))
    syncs = (ledger.ingest_runs.where((F.col("status") != "success") & (F.col("started_at") >= since))
             .select(F.col("started_at").alias("at"), F.lit("ingest").alias("step"), "error"))
    nodes = (ledger.node_runs.where(F.col("status").isin("error", "fail") & (F.col("completed_at") >= since))
             .select(F.col("completed_at").alias("at"), F.col("name").alias("step"), F.col("message").alias("error")))
    return syncs.unionByName(nodes).orderBy(F.col("at").desc())


def sync_by_hour(ingest_runs: DataFrame, now: datetime, days: int = 2) -> DataFrame:
    return (ingest_runs.where(F.col("started_at") >= instant(now - timedelta(days=days)))
            .groupBy(F.date_trunc("hour", "started_at").cast("timestamp_ntz").alias("hour"))
            .agg(F.count(F.lit(1)).alias("runs"), F.max(_seconds()).alias("max_seconds"),
                 F.sum("records_read").alias("records")).orderBy("hour"))


def delivery_gaps(node_runs: DataFrame, top: int, minutes: int = 15) -> DataFrame:
    """The `top` newest gaps between fact builds longer than `minutes`."""
    built = (node_runs.where((F.col("name") == FACT) & (F.col("resource_type") == "model")
                             & (F.col("status") == "success"))
             .select("completed_at", "unique_id", micros("completed_at").alias("_at")))
    lagged = scan(built, [], ["_at", "unique_id"], [Running("_before", "prev", F.col("_at"))])
    gap = F.round((F.col("_at") - F.col("_before")) / 60_000_000.0)
    return (lagged.select(F.col("completed_at").alias("build_after_gap"), gap.alias("gap_minutes"))
            .where(F.col("gap_minutes") > minutes).orderBy(F.col("build_after_gap").desc()).limit(top))


def node_cost_by_day(ledger: Ledger, now: datetime, days: int = 8) -> DataFrame:
    return (_owned(ledger, instant(now - timedelta(days=days))).where("resource_type = 'model'")
            .groupBy("name", F.date_trunc("day", "started_at").cast("timestamp_ntz").alias("day"))
            .agg(F.round(F.sum("execution_seconds").cast("double")).alias("total_seconds"),
                 F.sum("relation_rows").alias("relation_rows"), F.sum("bytes_billed").alias("bytes_billed"))
            .orderBy("name", "day"))


def slowest_models(ledger: Ledger, now: datetime, days: int = 7) -> DataFrame:
    total = F.sum("execution_seconds").cast("double")
    runs = F.count(F.lit(1))
    return (_owned(ledger, instant(now - timedelta(days=days))).where("resource_type = 'model'")
            .groupBy("name").agg(runs.alias("runs"), F.round(total).alias("total_seconds"),
                                 F.round(total / runs, 2).alias("avg_seconds"))
            .orderBy(F.col("total_seconds").desc()))


def elt_metrics(ledger: Ledger, now: datetime) -> DataFrame:
    """The whole report as metric samples (metric, label, value)."""
    totals = elt_windows(ledger, now)
    measured = [c for c in totals.columns if c != "window"]

    def melt(df, label, columns, prefix):
        pairs = F.array(*[F.struct(F.lit(f"{prefix}{c}").alias("metric"), F.col(c).cast("double").alias("value"))
                          for c in columns])
        return (df.select(F.col(label).alias("label") if label else F.lit(None).cast("string").alias("label"),
                          F.explode(pairs).alias("p")).select("p.metric", "label", "p.value"))

    sli_rows = slis(ledger, now)
    parts = [
        melt(totals, "window", measured, "elt_"),
        melt(elt_cost(totals), "window", ["cost_usd", "usd_per_million_records"], "elt_"),
        melt(elt_efficiency(totals), None,
             ["busy_ratio", "overhead_ratio", "write_amplification", "test_pass_ratio"], "elt_"),
        sli_rows.select(F.lit("slo_sli").alias("metric"), F.concat_ws("/", "slo", "window").alias("label"),
                        F.col("sli").alias("value")),
        melt(error_budgets(sli_rows), "slo", ["objective", "budget_left"], "slo_"),
        melt(ledger_age(ledger, now), None, ["age_days"], "ledger_"),
        melt(last_runs(ledger).select("step", (micros("finished_at") / 1e6).alias("finished"),
                                      F.col("succeeded").cast("double").alias("succeeded")),
             "step", ["finished", "succeeded"], "last_run_"),
    ]
    if ledger.has_builds:
        parts.append(melt(node_totals(ledger, now), "name", ["seconds", "rows_written", "bytes_billed"], "node_"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.where("value is not null")
