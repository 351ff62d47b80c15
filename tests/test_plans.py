"""Physical plans: exchanges, pushed filters and column pruning of the main models."""

import re

from pyspark.sql import functions as F

from tillwork.plans import features, marts
from tillwork.registry import payments
from tillwork.sources import mapping


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_card_features_share_one_exchange(spark, sf):
    text = plan(features.windowed_features(mapping.event_transactions(spark, sf)))
    assert len(re.findall(r"Exchange hashpartitioning\(card_token", text)) == 1
    assert len(re.findall(r"Exchange hashpartitioning\(merchant_id", text)) == 1
    assert "props" in text and "BatchEvalPython" not in text and "ArrowEvalPython" not in text


def test_fact_reuses_the_dedupe_partitioning(spark, sf):
    """Dedupe, rollups and both joins are on transaction_id: no exchange between them."""
    text = plan(payments.fct(spark, sf))
    assert len(re.findall(r"Exchange hashpartitioning\(transaction_id", text)) <= 4
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_daily_volume_aggregates_before_the_merchant_join(spark, sf):
    facts = payments.fct(spark, sf)
    text = plan(marts.merchant_daily_volume(facts, marts.dim_merchants(payments.merchants(spark, sf))))
    joins = [m.start() for m in re.finditer(r"Join", text)]
    assert text.index("HashAggregate") > joins[0]      # printed top down: the outermost join comes first
    scans = re.findall(r"ReadSchema: struct<([^>]*)>", text)
    assert all("c_acctbal" not in s and "l_quantity" not in s and "o_totalprice" not in s for s in scans)


def test_recent_filter_is_pushed(spark, sf):
    events = mapping.event_transactions(spark, sf)
    text = plan(features.recent(events).select("transaction_id"))
    assert re.search(r"PushedFilters: \[.*GreaterThanOrEqual\(ts", text)


def test_no_python_in_batch_models(spark, sf):
    for df in (payments.fct(spark, sf), features.feature_vector(
            payments.fct(spark, sf).withColumns({n: F.lit(0.0) for n in features.WINDOWED}))):
        assert "Python" not in plan(df)


def test_dedupe_keeps_the_dealing_of_the_order_join(spark, sf):
    """At size no table but the suppliers, by count, fits a broadcast: lines move once for their order, and none moves for its retries or customer."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(payments.staged(spark, sf)["transactions"])
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "hashpartitioning(transaction_id" not in text
    window = text[text.index("Window"):text.index("SortMergeJoin")]
    assert "Exchange" not in window and text.count("Exchange hashpartitioning(l_orderkey") == 1


def test_pinned_facts_hold_only_what_is_read(spark, sf, monkeypatch):
    from tillwork.registry import features as feature_queries, models, queries

    pinned = {}
    for module in (payments, feature_queries, models):
        monkeypatch.setattr(module, "materialize", lambda df, label: pinned.setdefault(label, df))
    queries()["txn_features"](spark, sf)
    assert pinned.pop("fct").columns == list(features.FACT_COLUMNS)
    models._training(spark, sf)
    assert pinned.pop("fct").columns == list(features.FACT_COLUMNS)
    queries()["dq_results"](spark, sf)
    assert len(pinned.pop("fct").columns) == 4
    queries()["fct_incremental"](spark, sf)
    assert "first-load" in pinned


def test_fact_moves_lines_once_and_no_transaction(spark, sf):
    """Transactions, refunds and chargebacks read the same columns of the lines, so that one shuffle serves all
    three; only refunds and chargebacks are dealt by transaction."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(payments.fct(spark, sf))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    lines = [re.sub(r"#\d+L?", "", s) for s in re.findall(r"FileScan parquet \[([^\]]*)\]", text) if s.startswith("l_orderkey")]
    assert len(lines) == 3 and len(set(lines)) == 1
    assert len(re.findall(r"Exchange hashpartitioning\(transaction_id", text)) == 2


def test_incremental_fact_leaves_old_rows_in_place(spark, sf):
    s = payments.staged(spark, sf)
    first = spark.createDataFrame(payments.fct(spark, sf).where("created_at < '1998-01-01'").limit(50).collect(),
                                  payments.fct(spark, sf).schema)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = marts.fct_incremental(first, s["transactions"], s["refunds"], s["chargebacks"], s["fx"], payments.DEALT)
        assert "Exchange hashpartitioning" not in plan(out)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    plain = marts.fct_incremental(first, s["transactions"].drop("l_orderkey"), s["refunds"], s["chargebacks"], s["fx"])
    assert out.count() == plain.count() > 50
    assert out.exceptAll(plain).count() == 0


def test_shuffle_files_go_with_their_job(spark, sf):
    from tillwork.session import prepare

    assert prepare(spark).conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "true"
    df = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    assert sorted(df.collect()) == sorted(df.collect())     # run again from the same plan


def test_merchant_rows_move_before_their_sums_are_made(spark, sf):
    """Printed top down: the rows move for the merchant first, without values made for its sums, then for the card."""
    df = features.windowed_features(mapping.event_transactions(spark, sf))
    text = plan(df)
    card, merchant = text.index("Exchange hashpartitioning(card_token"), text.index("Exchange hashpartitioning(merchant_id")
    assert card < merchant and "decimal(36,0)" not in text[merchant:] and "decimal(36,0)" in text[card:merchant]
    assert df.columns == [*mapping.event_transactions(spark, sf).columns, *features.WINDOWED]
