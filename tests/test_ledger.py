"""Ledger metrics on small hand-computed cases."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tillwork import schemas
from tillwork.plans import ledger as plan
from tillwork.plans import monitoring

NOW = datetime(2026, 3, 1, 12)


def ago(minutes, seconds=0):
    return NOW - timedelta(minutes=minutes) + timedelta(seconds=seconds)


def ingest(spark, runs):
    rows = [("r", None, ago(m), ago(m, s), status, False, records, 0, None) for m, s, status, records in runs]
    return spark.createDataFrame(rows, schemas.INGEST_RUNS)


def builds(spark, runs):
    """runs: (invocation, minutes ago, wall seconds, [(name, type, materialized, status, seconds, rows, bytes)])"""
    heads = [(i, "build", "t", None, ago(m), ago(m, w), len(nodes)) for i, m, w, nodes in runs]
    nodes = [(i, n, n, kind, mat, status, ago(m), ago(m, w), float(sec), None, rows, 0, None, billed, None, None)
             for i, m, w, items in runs for n, kind, mat, status, sec, rows, billed in items]
    return spark.createDataFrame(heads, schemas.BUILD_INVOCATIONS), spark.createDataFrame(nodes, schemas.NODE_RUNS)


def keyed(df, *keys, value="sli"):
    return {tuple(r[k] for k in keys): r[value] for r in df.collect()}


def test_nothing_recorded_gives_zeros_and_no_indicators(spark):
    bare = plan.Ledger(ingest(spark, []), *builds(spark, []))
    totals = plan.elt_windows(bare, NOW).collect()
    assert sorted(r["window"] for r in totals) == ["24h", "30d", "7d"]
    assert all(r[c] == 0.0 for r in totals for c in ("ingest_runs", "ingest_seconds", "records", "builds"))
    assert plan.slis(bare, NOW).isEmpty() and plan.ledger_age(bare, NOW).first()[0] == 0.0
    assert plan.elt_windows(plan.Ledger(ingest(spark, []), None, None), NOW).count() == 3


def random_ledger(seed, n=40):
    """Runs and builds of the last five weeks."""
    rng = random.Random(seed)
    runs = [(rng.randrange(1, 50_000), rng.randrange(1, 700), rng.choice(["success", "success", "error"]), rng.randrange(500)) for _ in range(n)]
    kinds = [("fct_transactions", "model", "incremental"), ("dim_merchants", "model", "table"), ("some_check", "test", "test")]
    heads = []
    for i in range(n):
        items = [(*kind, rng.choice(["skipped", "error" if kind[1] == "model" else "fail", *["success" if kind[1] == "model" else "pass"] * 3]),
                  rng.randrange(60), rng.choice([None, rng.randrange(900)]), rng.choice([None, 2 ** rng.randrange(20, 41)])) for kind in kinds]
        heads.append((f"build-{i}", rng.randrange(1, 50_000), rng.randrange(1, 600), items))
    return runs, heads


@pytest.mark.parametrize("seed", [1, 2])
def test_windows_against_plain_sums(spark, seed):
    runs, heads = random_ledger(seed)
    full = plan.Ledger(ingest(spark, runs), *builds(spark, heads))
    got = {r["window"]: r for r in plan.elt_windows(full, NOW).collect()}
    shown = keyed(plan.slis(full, NOW), "slo", "window")
    for window, days in (("24h", 1), ("7d", 7), ("30d", 30)):
        recent = [r for r in runs if r[0] <= days * 1440]
        items = [x for _, m, _, own in heads if m <= days * 1440 for x in own]
        models, tests = ([x for x in items if x[1] == kind and x[3] != "skipped"] for kind in ("model", "test"))
        good, fast = [r for r in recent if r[2] == "success"], [r for r in recent if r[2] == "success" and r[1] <= 300]
        row = got[window]
        assert (row["ingest_runs"], row["records"], row["ingest_seconds"]) == (len(recent), sum(r[3] for r in recent), sum(r[1] for r in recent))
        assert (row["builds"], row["tests"]) == (len(models), len(tests))
        # Rows of the table count for whole rebuilds; an incremental model counts what it reports, here nothing.
        assert row["rows_written"] == sum(x[5] or 0 for x in items if x[2] == "table")
        assert row["bytes_billed"] == sum(x[6] or 0 for x in items)
        steps = len(recent) + len(models)
        if steps:
            assert shown["elt_step_success", window] == pytest.approx((len(good) + sum(x[3] == "success" for x in models)) / steps)
        if good:
            assert shown["ingest_duration", window] == pytest.approx(len(fast) / len(good))


@pytest.mark.parametrize("limit", ["200000", "5"])
def test_delivery_against_a_walk_over_minutes(spark, limit):
    minutes = [200, 190, 188, 120, 119, 60, 20, 3]
    done = [("fct_transactions", "model", "incremental", "success", 1, 1, None)]
    _heads, nodes = builds(spark, [(f"b{m}", m, 30, done) for m in minutes])
    built = [ago(m, 30) for m in minutes]
    walk, at = [], min(built)
    while at < NOW:
        walk.append((at - max(b for b in built if b <= at)).total_seconds() <= 900)
        at += timedelta(minutes=1)
    spark.conf.set("spark.tillwork.hotGroupRows", limit)
    try:
        assert keyed(plan.delivery_sli(nodes, NOW), "window")["24h",] == pytest.approx(sum(walk) / len(walk))
    finally:
        spark.conf.unset("spark.tillwork.hotGroupRows")


def test_costs_add_up_and_budgets_are_linear(spark):
    one = spark.range(1)
    cost = [one.select(plan.estimated_cost(F.lit(float(s)), F.lit(float(b)))).first()[0] for s, b in ((1800, 0), (0, 2 ** 38), (1800, 2 ** 38))]
    assert cost[0] == pytest.approx(0.134 / 2) and cost[1] == pytest.approx(6.25 / 4) and cost[2] == pytest.approx(cost[0] + cost[1])
    left = [one.select(plan.error_budget_left(F.lit(1 - 0.02 * share), F.lit(0.98))).first()[0] for share in (0, 0.25, 1, 3)]
    assert left == pytest.approx([1, 0.75, 0, -2])


def test_alerts_pending_then_firing(spark, split):
    base = datetime(2026, 1, 1)
    ages = [100, 1000, 1100, 1200, 1300, 1400, 1500, 1600, 200, 1000]
    samples = [(base + timedelta(minutes=i), "freshness_seconds", "mart", float(a)) for i, a in enumerate(ages)]
    samples += [(base + timedelta(minutes=i), "scorer_up", "s", 1.0) for i in range(len(ages))]
    metrics = spark.createDataFrame(samples, "at timestamp, metric string, label string, value double")
    states = monitoring.sustained(monitoring.evaluate_rules(metrics))
    mart = [r["state"] for r in states.where("alert = 'MartDataStale'").orderBy("at").collect()]
    assert mart == ["inactive"] + ["pending"] * 5 + ["firing"] * 2 + ["inactive", "pending"]
    assert [(r["alert"], r["state"]) for r in monitoring.alert_list(states).collect()] == [
        ("MartDataStale", "pending"), ("SourceQuiet", "pending")][:1]


def test_absent_scorer_is_down(spark):
    metrics = spark.createDataFrame([(datetime(2026, 1, 1), "busy_ratio", "all", 0.1)],
                                    "at timestamp, metric string, label string, value double")
    down = monitoring.evaluate_rules(metrics).where("active").collect()
    assert [r["alert"] for r in down] == ["ScorerDown"]


def test_histogram_quantile_edges(spark):
    rows = [(0.1, 0), (0.5, 5), (1.0, 10), (float("inf"), 10)]
    buckets = spark.createDataFrame(rows, "le double, n long")
    assert monitoring.histogram_quantile(buckets, 0.5).first()[0] == pytest.approx(0.5)
    assert monitoring.histogram_quantile(buckets, 0.75).first()[0] == pytest.approx(0.75)
    over = spark.createDataFrame([(0.1, 1), (float("inf"), 10)], "le double, n long")
    assert monitoring.histogram_quantile(over, 0.99).first()[0] == pytest.approx(0.1)
