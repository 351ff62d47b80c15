"""The streaming job over several ordered batches."""

import json
import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tillwork import registry
from tillwork.session import scratch_path
from tillwork.sources import mapping
from tillwork.streaming import events, feature_sink as sinks, feature_stream as job
from tillwork.streaming.processors import window_features

BASE = datetime(2026, 1, 1)


def message(i, card, second, amount=10.0, merchant="m", country=None, **other):
    return {"transaction_id": str(i), "card_token": card, "merchant_id": merchant, "amount": amount, "currency": "CAD",
            "entry_mode": "chip", "created_at": (BASE + timedelta(seconds=second)).isoformat() + "+00:00",
            "ip_country": country, **other}


def feed(spark, batches):
    """A file stream with one file, and so one micro-batch, per list of messages."""
    folder = scratch_path(spark, "feed")
    os.makedirs(folder)
    offset = 0
    for b, batch in enumerate(batches):
        path = f"{folder}/{b:03d}.json"
        with open(path, "w") as out:
            for m in batch:
                text = m if isinstance(m, str) else json.dumps(m)
                out.write(json.dumps({"value": text, "part": 0, "offset": offset}) + "\n")
                offset += 1
        os.utime(path, (1_700_000_000 + b, 1_700_000_000 + b))
    return events.event_stream(spark, "json", {"path": folder, "maxFilesPerTrigger": "1"},
                               spark.range(0).selectExpr("'' value", "0 part", "0L offset").schema)


def run(spark, stream, **sink):
    path = scratch_path(spark, "out")
    query = job.write_features(stream, sinks.FeatureSink(path, **sink), scratch_path(spark, "ckpt"), available_now=True)
    assert query.awaitTermination(300)
    return sinks.features(spark, path), query


def by_id(df):
    return {(r["transaction_id"], r["is_late"]): r for r in df.collect()}


def test_three_batches(spark):
    batches = [
        [message(1, "c", 0, country="CA"), message(2, "c", 300, 5.5), message(2, "c", 300, 5.5), message(3, "d", 301)],
        [message(4, "c", 3600, country="US"), message(5, "c", 3500), message(1, "c", 0), "not json",
         message(6, "c", 3700, amount="abc"), {"transaction_id": "7"}],
        [message(8, "c", 3601, country="US"), message(9, "c", 9000), message(10, "c", 3600)],
    ]
    valid, invalid = events.parse_events(feed(spark, batches))
    rows, _query = run(spark, job.feature_stream(valid))
    got = by_id(rows)
    assert set(got) == {("1", False), ("2", False), ("3", False), ("4", False), ("5", False), ("1", True), ("8", False),
                        ("9", False), ("10", True)}
    two = got["2", False]
    assert (two["card_txn_count_5m"], two["card_amount_sum_1h"], two["seconds_since_last_card_txn"]) == (2, 15.5, 300.0)
    four = got["4", False]      # the event exactly an hour ago has left the window
    assert (four["card_amount_sum_1h"], four["is_new_ip_country"]) == (15.5, True)
    five = got["5", False]      # out of order, within the allowed lateness
    assert five["seconds_since_last_card_txn"] is None and five["card_txn_count_5m"] == 1
    assert got["8", False]["is_new_ip_country"] is False and got["8", False]["seconds_since_last_card_txn"] == 1.0
    assert got["1", True]["card_txn_count_5m"] is None
    path = scratch_path(spark, "dead")
    dead = job.write_dead_letters(invalid, path, scratch_path(spark, "ckpt"), available_now=True)
    assert dead.awaitTermination(300) and spark.read.parquet(path).count() == 3


def test_state_from_history(spark):
    history = [(str(i), "c", "m", float(10 + i % 3), BASE + timedelta(seconds=60 * i), "CA") for i in range(40)]
    fct = spark.createDataFrame(history, "transaction_id string, card_token string, merchant_id string, amount double,"
                                         "created_at timestamp, ip_country string")
    valid, _invalid = events.parse_events(feed(spark, [[message(100, "c", 2400, 20.0, country="US"), message(5, "c", 2401)]]))
    cards, merchants = job.initial_state(fct)
    rows, _query = run(spark, job.feature_stream(valid, cards=cards), merchants=merchants)
    got = by_id(rows)
    assert set(got) == {("100", False)}     # transaction 5 is known from the history
    r = got["100", False]
    amounts = [h[3] for h in history]
    mean = sum(amounts) / 40
    sd = (sum((a - mean) ** 2 for a in amounts) / 39) ** 0.5
    assert r["card_txn_count_5m"] == 6 and r["is_new_ip_country"] and r["seconds_since_last_card_txn"] == 60.0
    assert r["merchant_amount_zscore"] == pytest.approx((20 - mean) / sd)


def test_scoring_fails_open(spark):
    from tillwork.plans import scoring

    train = spark.range(400).select(
        F.col("id").cast("string").alias("transaction_id"), (F.col("id") % 5 == 0).alias("label"),
        F.when(F.col("id") % 5 == 0, 900).otherwise(20).cast("decimal(18,2)").alias("amount_cad"),
        F.lit("chip").alias("entry_mode"), *[F.lit(None).cast("string").alias(c) for c in (
            "avs_result", "cvv_result", "three_ds_authenticated", "network_risk_score")],
        F.lit(1).alias("card_txn_count_5m"), F.lit(1.0).alias("card_amount_sum_1h"), F.lit(None).cast("double").alias("seconds_since_last_card_txn"),
        F.lit(False).alias("is_new_ip_country"), F.lit(0.0).alias("merchant_amount_zscore"))
    model = scoring.train(train, iterations=3, depth=2)
    batch = [message(1, "c", 0, 900.0), message(2, "c", 5, 15.0), {**message(3, "c", 9), "currency": "XXX"}]
    valid, _invalid = events.parse_events(feed(spark, [batch]))
    rows, _query = run(spark, job.feature_stream(valid), score=scoring.score_stream(model, mapping.fx_rates(spark)))
    got = by_id(rows)
    assert got["1", False]["fraud_score"] > 0.5 > got["2", False]["fraud_score"]
    assert got["3", False]["fraud_score"] is None and got["3", False]["card_txn_count_5m"] == 3


def test_online_view_and_compaction(spark):
    path = scratch_path(spark, "online")
    write = job.serve_latest(path)
    schema = "card_token string, transaction_id string, event_time timestamp, is_late boolean"
    batches = [[("a", "1", BASE, False), ("b", "2", BASE, False)], [("a", "3", BASE + timedelta(seconds=5), False),
                                                                    ("b", "4", BASE + timedelta(seconds=9), True)]]
    for i, rows in enumerate(batches):
        write(spark.createDataFrame(rows, schema), i)
    write(spark.createDataFrame(batches[1], schema), 1)      # a repeated batch changes nothing

    def view():
        return sorted((r["card_token"], r["transaction_id"]) for r in job.online_view(spark, path).collect())

    assert view() == [("a", "3"), ("b", "2")]
    job.compact_online(spark, path)
    assert view() == [("a", "3"), ("b", "2")]
    write(spark.createDataFrame([("b", "5", BASE + timedelta(seconds=20), False)], schema), 2)
    assert view() == [("a", "3"), ("b", "5")]


def test_state_expiry_mode_runs(spark):
    """With expiry the stream runs on, so it is stopped once its output is there."""
    import time

    valid, _invalid = events.parse_events(feed(spark, [[message(1, "c", 0), message(2, "c", 10)]]))
    path = scratch_path(spark, "ttl")
    query = job.write_features(job.feature_stream(valid, ttl_days=job.STATE_TTL_DAYS), sinks.FeatureSink(path), scratch_path(spark, "ckpt"))
    try:
        deadline = time.time() + 120
        while time.time() < deadline and not any(p.numInputRows for p in query.recentProgress):
            time.sleep(0.5)
        assert by_id(sinks.features(spark, path))["2", False]["card_txn_count_5m"] == 2
    finally:
        query.stop()


def test_stateful_steps_travel_without_the_package(tmp_path):
    """Workers of a cluster have no copy of this package."""
    import subprocess
    import sys

    from pyspark import cloudpickle

    from tillwork.streaming import processors

    steps = [processors.LateTagger(600), processors.CardFeatures(60)]
    (tmp_path / "steps").write_bytes(cloudpickle.dumps(steps))
    code = "import pickle,sys; print([type(s).__name__ for s in pickle.load(open('steps','rb'))], 'tillwork' in sys.modules)"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert done.stdout.strip() == "['LateTagger', 'CardFeatures'] False", done.stderr


def test_outcomes_add_up_over_any_number_of_batches(spark, tmp_path):
    """150 batches: more than a query keeps progress reports of."""
    from tillwork.streaming import feature_stream

    source, seen = tmp_path / "in", tmp_path / "out"
    spark.range(150).selectExpr("id", "id % 10 <> 0 as valid").repartition(150).write.parquet(str(source))
    files = len(list(source.glob("part-*")))
    stream = spark.readStream.schema("id long, valid boolean").option("maxFilesPerTrigger", 1).parquet(str(source))
    query = (stream.writeStream.format("parquet").option("path", str(seen)).option("checkpointLocation", str(tmp_path / "c"))
             .trigger(availableNow=True).start())
    assert query.awaitTermination(240) and files > 100
    features = spark.range(120).selectExpr("id % 4 = 0 as is_late")
    got = {r["outcome"]: r["n"] for r in feature_stream.outcomes(spark.read.parquet(str(seen)), features).collect()}
    assert got == {"processed": 90, "late": 30, "invalid": 15, "duplicate": 15}


def test_lag_is_a_number_per_partition():
    from tillwork.streaming.feature_stream import lag_rows

    rows = lag_rows("k", '{"t": {"0": 5}}', '{"t": {"0": 9, "1": 4}, "u": {"0": 1}}')
    assert [(r["topic"], r["partition"], r["lag"]) for r in rows] == [("t", 0, 4), ("t", 1, 4), ("u", 0, 1)]
    assert lag_rows("f", '{"logOffset": 3}', None) == [] and lag_rows("f", "3", "x") == [] and lag_rows("f", None, '{"a": 1}') == []


def plain_windows(ts, amounts, at, held, last):
    """Row by row: a window that the newest time so far cuts off."""
    window, out = list(zip(at, held)), []
    for t, a in zip(ts, amounts):
        last = t if last is None else max(last, t)
        window = [(x, v) for x, v in window + [(t, a)] if x > last - 3600 * 10**6]
        seen = [(x, v) for x, v in window if x <= t]
        out.append((sum(x >= t - 300 * 10**6 for x, _ in seen), sum(v for _, v in seen)))
    return out, sorted(window)


def test_windows_against_row_by_row():
    import random

    import numpy as np

    rng = random.Random(6)
    for _ in range(150):
        n, base, ts = rng.randint(1, 60), 10**12, []
        for _ in range(n):
            base += rng.choice([0, 1, 30, 200, 900, 4000]) * 10**6
            ts.append(base - rng.choice([0, 0, 0, 1, 100, 599]) * 10**6)
        amounts = [rng.randint(1, 9) for _ in ts]
        cut = rng.randint(0, n - 1)
        want, left = plain_windows(ts, amounts, [], [], None)
        arrays = [np.array(x, np.int64) for x in (ts[:cut], amounts[:cut], ts[cut:], amounts[cut:])]
        at, held, last, got = np.zeros(0, np.int64), np.zeros(0, np.int64), None, []
        for t, a in (arrays[:2], arrays[2:]):
            if len(t):
                counts, sums, newest, at, held = window_features(t, a, at, held, last)
                last = int(newest[-1])
                got += list(zip(counts.tolist(), sums.tolist()))
        assert got == want and sorted(zip(at.tolist(), held.tolist())) == left


def test_a_busy_merchant_is_split_and_batches_add_up(spark, split):
    import random
    import statistics

    rng = random.Random(8)
    amounts = [round(rng.uniform(1, 500), 2) for _ in range(120)]
    moments, got = spark.createDataFrame([("idle", 3, 5.0, 1.0)], sinks.MOMENTS), {}
    for low in (0, 50, 51):
        high = {0: 50, 50: 51, 51: 120}[low]
        rows = spark.createDataFrame([(i, 0, i % 10 == 3, "m", amounts[i]) for i in range(low, high)], "offset long, part int, is_late boolean, merchant_id string, amount double")
        scored, moments = sinks.merchant_scores(rows.repartition(3), moments)
        got |= {r["offset"]: r["merchant_amount_zscore"] for r in scored.collect()}
        moments = spark.createDataFrame(moments.collect(), sinks.MOMENTS)
    before = []
    for i, amount in enumerate(amounts):
        if i % 10 == 3:
            assert got[i] is None
            continue
        want = (amount - statistics.mean(before)) / statistics.stdev(before) if len(before) >= 30 else 0.0
        assert got[i] == pytest.approx(want, abs=1e-9)
        before.append(amount)
    carried = {r["merchant_id"]: r for r in moments.collect()}
    assert carried["idle"]["n"] == 3 and carried["m"]["n"] == len(before) and carried["m"]["mean"] == pytest.approx(statistics.mean(before))


def test_a_repeated_batch_replaces_itself_and_errors_leave_rows_unscored(spark):
    def broken(rows):
        return rows.withColumn("fraud_score", F.raise_error(F.lit("out of order")).cast("double")).withColumn("model_version", F.lit("1"))

    path = scratch_path(spark, "sink")
    sink = sinks.FeatureSink(path, score=broken)
    columns = "offset long, part int, is_late boolean, merchant_id string, amount double, transaction_id string, card_token string, currency string, " \
              "entry_mode string, event_time timestamp, processed_at timestamp, card_txn_count_5m long, card_amount_sum_1h double, " \
              "seconds_since_last_card_txn double, is_new_ip_country boolean"
    row = (1, 0, False, "m", 5.0, "t", "c", "CAD", "chip", BASE, BASE, 1, 5.0, None, False)
    for batch_id in (0, 1, 1):
        sink(spark.createDataFrame([row], columns), batch_id)
    rows = sinks.features(spark, path).collect()
    assert len(rows) == 2 and all(r["fraud_score"] is None and "out of order" in r["score_error"] for r in rows)
    metrics = {(r["labels"]["outcome"], r["value"]) for r in sinks.outcome_metrics(spark, path).collect()}
    assert metrics == {("processed", 1.0), ("late", 0.0), ("scored", 0.0), ("failed", 1.0)}
    last = spark.read.parquet(f"{path}/moments").where("batch = 1").first()
    assert (last["merchant_id"], last["n"]) == ("m", 2)


def test_the_listener_writes_lag_that_the_alert_rule_reads(spark, tmp_path):
    from types import SimpleNamespace

    progress = SimpleNamespace(timestamp="2026-01-01T00:00:00.000Z", sources=[SimpleNamespace(
        description="k", endOffset='{"t": {"0": 5}}', latestOffset='{"t": {"0": 90, "1": 4}}')])
    listener = sinks.LagListener(spark, str(tmp_path / "lag"))
    listener.onQueryProgress(SimpleNamespace(progress=progress))
    listener.onQueryProgress(SimpleNamespace(progress=SimpleNamespace(timestamp="x", sources=[SimpleNamespace(description="f", endOffset="3", latestOffset=None)])))
    rows = spark.read.parquet(str(tmp_path / "lag")).collect()
    assert {(r["metric"], r["labels"]["partition"], r["value"]) for r in rows} == {("stream_consumer_lag", "0", 85.0), ("stream_consumer_lag", "1", 4.0)}


class HeldMap:
    """A map state in memory."""

    def __init__(self):
        self.entries = {}

    def getValue(self, key):
        return self.entries.get(key)

    def updateValue(self, key, value):
        self.entries[key] = value

    def removeKey(self, key):
        del self.entries[key]


class HeldStates:
    def __init__(self):
        self.maps = {}

    def getMapState(self, name, *_):
        return self.maps.setdefault(name, HeldMap())


def test_one_bucket_handles_many_cards_and_files_many_ids(monkeypatch):
    import pandas as pd

    from tillwork.streaming import processors

    monkeypatch.setattr(processors, "INLINE_IDS", 3)
    step, states = processors.CardFeatures(7200), HeldStates()
    step.init(states)

    def batch(rows):
        frame = pd.DataFrame(rows, columns=["offset", "card_token", "transaction_id", "second", "amount", "ip_country"])
        frame["micros"], frame["is_late"], frame["_bucket"] = frame.pop("second") * 10**6, False, 1
        out = pd.concat(step.handleInputRows((1,), iter([frame[1::2], frame[::2]]), None))
        return {(r["card_token"], r["transaction_id"]): (r["card_txn_count_5m"], r["card_amount_sum_1h"]) for _, r in out.iterrows()}

    first = batch([(k, "ab"[k % 2], f"t{k // 2}", 100 * (k // 2), 1.0 + k % 2, None) for k in range(20)])
    assert len(first) == 20 and first["a", "t9"] == (4, 10.0) and first["b", "t9"] == (4, 20.0)
    assert states.maps["cards"].entries["a",][4] == [] and states.maps["cards"].entries["a",][6] == [0]
    again = batch([(30, "a", "t0", 1000, 1.0, None), (31, "b", "t11", 1000, 1.0, None), (32, "c", "t0", 0, 1.0, None)])
    assert set(again) == {("b", "t11"), ("c", "t0")}
    later = batch([(40, "a", "t0", 11_000, 1.0, None), (41, "a", "t0", 11_001, 1.0, None)])
    assert set(later) == {("a", "t0")} and ("a", 0) not in states.maps["seen"].entries


def test_state_is_keyed_by_buckets_not_by_cards(spark):
    valid, _invalid = events.parse_events(feed(spark, [[message(1, "c", 0)]]))
    plan = job.feature_stream(valid)._jdf.queryExecution().analyzed().toString()
    assert plan.count("_bucket") and f"pmod(xxhash64(card_token" in plan


def test_an_event_is_parsed_once(spark):
    raw = spark.createDataFrame([("{}", 0, 1), (None, 0, 2), ("[", 0, 3)], "value string, part int, offset bigint")
    valid, invalid = events.parse_events(raw)
    for parsed in (valid, invalid):
        assert parsed._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1
    assert (valid.count(), sorted(r["offset"] for r in invalid.collect())) == (0, [1, 2, 3])


def test_late_replay_hands_over_what_it_shows(spark, sf, monkeypatch):
    seen, tag_late = [], job.tag_late
    monkeypatch.setattr(job, "tag_late", lambda rows: seen.extend(rows.columns) or tag_late(rows))
    assert registry.queries()["stream_late"](spark, sf).count() > 0
    assert sorted(seen) == ["event_time", "offset", "part", "transaction_id"]


def test_a_replay_keeps_events_of_any_age_once(spark, tmp_path):
    import duckdb

    # Two copies of a month under other ids: the second one's events are up to a month behind the first one's.
    copies = duckdb.sql("select event_id + i * 1000 as event_id, user_id, event_type, ts, value, props "
                        "from '/root/testdata/sf0.001/events.parquet', range(2) r(i) order by i, event_id")
    copies.write_parquet(f"{tmp_path}/events.parquet")
    n = copies.aggregate("count(distinct event_id)").fetchall()[0][0]
    got = registry.queries()["stream_dedupe"](spark, str(tmp_path))
    assert (got.count(), got.select("transaction_id").distinct().count()) == (n, n)
