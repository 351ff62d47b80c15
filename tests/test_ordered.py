"""Ordered operators: the split path must equal the plain one and a brute-force computation."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillwork.operators import ordered
from tillwork.operators.ordered import Running, asof_left, exact_quantiles, nth_row, scan, sliding_sums
from tillwork.plans import features
from tillwork.registry.features import timed_events

ROWS = [("a" if i % 3 else ("b" if i % 2 else None), (i * 37) % 101, i, None if i % 7 == 0 else i % 11)
        for i in range(300)]


@pytest.fixture
def numbers(spark):
    return spark.createDataFrame(ROWS, "k string, t long, id long, v long").repartition(5)


def brute(kind, rows, i, current):
    frame = rows[: i + 1] if current else rows[:i]
    if kind == "prev":
        return rows[i - 1][3] if i else None
    values = [r[3] for r in frame if r[3] is not None]
    if kind == "count":
        return len(values)
    if not values:
        return None
    return {"sum": sum, "min": min, "max": max, "last": lambda v: v[-1]}[kind](values)


@pytest.mark.parametrize("current", [True, False])
def test_scan_matches_brute_force(numbers, split, current):
    kinds = ["sum", "count", "min", "max", "last", "prev"]
    out = scan(numbers, ["k"], ["t", "id"], [Running(k + "_", k, F.col("v"), current) for k in kinds])
    groups = {}
    for r in sorted(ROWS, key=lambda r: (r[1], r[2])):
        groups.setdefault(r[0], []).append(r)
    want = {r[2]: tuple(brute(k, rows, i, current) for k in kinds)
            for rows in groups.values() for i, r in enumerate(rows)}
    got = {r["id"]: tuple(r[k + "_"] for k in kinds) for r in out.collect()}
    assert got == want


def test_scan_split_has_the_plain_schema(spark, numbers):
    outs = [Running("s", "sum", F.col("v").cast("decimal(18,2)")), Running("n", "count", F.col("v"))]
    plain = scan(numbers, ["k"], ["t", "id"], outs, limit=10**6)
    parted = scan(numbers, ["k"], ["t", "id"], outs, limit=3)
    assert plain.schema.simpleString() == parted.schema.simpleString()
    assert sorted(map(str, plain.collect())) == sorted(map(str, parted.collect()))


def test_scan_without_keys(numbers, split):
    out = scan(numbers, [], ["t", "id"], [Running("n", "count", F.lit(1))])
    ordered_ids = [r[2] for r in sorted(ROWS, key=lambda r: (r[1], r[2]))]
    assert [r["id"] for r in out.orderBy("n").collect()] == ordered_ids


@pytest.mark.parametrize("limit", [10**6, 3])
def test_sliding_sums_count_peers_and_both_edges(spark, limit):
    rows = [("c", t, i) for i, t in enumerate([0, 0, 5, 10, 10, 11, 20, 31])]
    df = spark.createDataFrame(rows, "k string, t long, id long")
    out = sliding_sums(df, ["k"], "t", "id", {"n": (F.lit(1).cast("long"), 10), "s": (F.col("id"), 5)}, limit=limit)
    got = {r["id"]: (r["n"], r["s"]) for r in out.collect()}
    want = {i: (sum(t - 10 <= u <= t for _, u, _ in rows), sum(j for _, u, j in rows if t - 5 <= u <= t))
            for _, t, i in rows}
    assert got == want


@pytest.mark.parametrize("limit", [10**6, 2])
def test_sliding_sums_of_frames_without_values_are_null(spark, limit):
    rows = [("c", 0, 1, 5), ("c", 10, 2, None), ("c", 20, 3, 7), ("c", 20, 4, -7), ("d", 0, 5, None)]
    df = spark.createDataFrame(rows, "k string, t long, id long, v long")
    out = sliding_sums(df, ["k"], "t", "id", {"s": (F.col("v"), 1)}, limit=limit)
    assert {r["id"]: r["s"] for r in out.collect()} == {1: 5, 2: None, 3: 0, 4: 0, 5: None}


def test_only_busy_keys_are_cut_into_segments_of_bounded_size(spark, monkeypatch):
    pinned = []
    keep = ordered.materialize

    def watch(df, label):
        out = keep(df, label)
        if label == "segments":
            pinned.append(out)
        return out
    monkeypatch.setattr(ordered, "materialize", watch)
    df = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(-1).alias("k"), "id")
    out = scan(df, ["k"], ["id"], [Running("n", "count", F.col("id"))], limit=1000)
    assert out.where("k = -1").agg(F.max("n")).first()[0] == 40_000 and out.count() == 60_000
    sizes = pinned[0].groupBy("_seg").count().collect()
    assert {r["k"] for r in pinned[0].select("k").distinct().collect()} == {-1}
    assert max(r["count"] for r in sizes) <= 2000 and len(sizes) >= 40


def test_zscore_of_large_nearly_equal_amounts(spark):
    amounts = [1_000_000 + (i % 2) / 100 for i in range(60)]
    rows = spark.createDataFrame([("m", i, str(i).zfill(3), a) for i, a in enumerate(amounts)], "merchant_id string, _at long, transaction_id string, a double")
    got = [r[0] for r in features.merchant_zscore(rows.withColumn("amount", F.col("a").cast("decimal(18,2)"))).orderBy("_at").select("merchant_amount_zscore").collect()]
    for i in range(30, 60):
        past = np.array([j % 2 for j in range(i)])
        assert got[i] == pytest.approx((i % 2 - past.mean()) / past.std(ddof=1), rel=1e-9)


def test_features_are_the_same_when_every_key_is_split(spark, sf):
    def run():
        out = features.windowed_features(timed_events(spark, sf).drop("_at"))
        return sorted(str(r) for r in out.withColumn(
            "merchant_amount_zscore", F.round("merchant_amount_zscore", 9)).select(sorted(out.columns)).collect())

    plain = run()
    spark.conf.set("spark.tillwork.hotGroupRows", "3")
    try:
        assert run() == plain
    finally:
        spark.conf.unset("spark.tillwork.hotGroupRows")


@pytest.mark.parametrize("limit", ["200000", "3"])
def test_asof_takes_the_latest_at_or_before(spark, limit):
    base = datetime(2024, 1, 1)
    rng = random.Random(1)
    lefts = [(i, base + timedelta(minutes=rng.randrange(200))) for i in range(80)]
    rights = sorted({base + timedelta(minutes=rng.randrange(20, 180)) for _ in range(15)})
    left = spark.createDataFrame(lefts, "id long, t timestamp")
    right = spark.createDataFrame([(t, str(t)) for t in rights], "done timestamp, name string")
    spark.conf.set("spark.tillwork.hotGroupRows", limit)
    try:
        got = {r["id"]: r["name"] for r in asof_left(left, right, "t", "done", ["name"]).collect()}
    finally:
        spark.conf.unset("spark.tillwork.hotGroupRows")
    want = {i: next((str(r) for r in reversed(rights) if r <= t), None) for i, t in lefts}
    assert got == want


def test_quantiles_and_order_statistics(spark, split):
    values = [(float((i * 7919) % 101) / 4,) for i in range(257)]
    df = spark.createDataFrame(values, "v double").withColumn("id", F.monotonically_increasing_id())
    shares = [0.1, 0.25, 0.5, 0.99, 1.0]
    got = exact_quantiles(df, "v", shares).first()["quantiles"]
    assert got == pytest.approx(list(np.quantile([v for v, in values], shares)))
    rows = sorted((r["v"], r["id"]) for r in df.collect())
    assert nth_row(df, ["v", "id"], 1) == rows[0]
    assert nth_row(df, ["v", "id"], 100) == rows[99]
    assert nth_row(df, ["v", "id"], 257) == rows[-1]


def test_dedupe_trims_before_the_shuffle(spark, sf):
    from tillwork.plans.staging import stg_transactions
    from tillwork.sources.mapping import raw_transactions

    plan = stg_transactions(raw_transactions(spark, sf))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    assert ordered.SLIDING_ROWS <= 20_000
