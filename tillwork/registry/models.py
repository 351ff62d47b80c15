"""Queries over ranking metrics, splits and the fraud model."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillwork.plans import features as feat
from tillwork.plans import scoring
from tillwork.registry.base import P_EVENTS, query
from tillwork.registry.features import TXN_AS_OF
from tillwork.registry.payments import fct
from tillwork.session import materialize
from tillwork.sources import mapping


def scored_events(spark, sf_dir, score="value"):
    return mapping.table(spark, sf_dir, "events").select(
        F.col("event_id").alias("transaction_id"), F.expr(score).alias("score"), (F.col("event_type") == "error").alias("label"))


def ranking_sql(score: str) -> str:
    return f"""
    r as (select event_id, {score} as s, case when event_type = 'error' then 1 else 0 end as y from events),
    g as (select s, sum(y) as pos, count(*) as n from r group by 1),
    c as (select *, sum(pos) over w as tp, sum(n) over w as seen, (select sum(y) from r) as p, (select count(*) from r) as total
          from g window w as (order by s desc)),
    top as (select * from r order by s desc, event_id limit (select greatest(1, floor(count(*) * 0.01)::bigint) from r)),
    metrics as (
      select (select sum(pos / p * tp / seen) from c) as pr_auc,
             (select sum((n - pos) * (tp - pos / 2)) / max(p * (total - p)) from c) as roc_auc,
             (select min(s) from top) as threshold_at_1pct, (select avg(y) from top) as precision_at_1pct,
             (select sum(y) from top) / (select sum(y) from r) as recall_at_1pct)"""


METRICS = ("pr_auc", "roc_auc", "threshold_at_1pct", "precision_at_1pct", "recall_at_1pct")
ROUNDED = ", ".join(f"round({m}, 8) as {m}" for m in METRICS)


@query("ranking_metrics", f"with {ranking_sql('value')} select {ROUNDED} from metrics")
def _(spark, sf_dir):
    return scoring.evaluate(scored_events(spark, sf_dir)).select(*[F.round(m, 8).alias(m) for m in METRICS])


@query("ranking_metrics_ties", f"with {ranking_sql('floor(value / 20)')} select {ROUNDED} from metrics")
def _(spark, sf_dir):
    """Scores in a few steps, so that most rows are tied and the cutoff falls inside a tie."""
    tied = scored_events(spark, sf_dir, "cast(floor(value / 20) as double)")
    return scoring.evaluate(tied).select(*[F.round(m, 8).alias(m) for m in METRICS])


@query("compare_models", f"""
    with {ranking_sql('value')},
    metrics_a as (select pr_auc from metrics),
    r2 as (select event_id, -value as s, case when event_type = 'error' then 1 else 0 end as y from events),
    g2 as (select s, sum(y) as pos, count(*) as n from r2 group by 1),
    c2 as (select *, sum(pos) over w as tp, sum(n) over w as seen, (select sum(y) from r2) as p
           from g2 window w as (order by s desc))
    select round(a.pr_auc, 8) as challenger_pr_auc, round(b.ap, 8) as champion_pr_auc, a.pr_auc > b.ap as promote
    from metrics_a a, (select sum(pos / p * tp / seen) as ap from c2) b""")
def _(spark, sf_dir):
    out = scoring.compare_models(scored_events(spark, sf_dir), scored_events(spark, sf_dir, "-value"))
    return out.withColumns({c: F.round(c, 8) for c in ("challenger_pr_auc", "champion_pr_auc")})


@query("time_split", f"""
    with {P_EVENTS},
    o as (select *, row_number() over (order by created_at, transaction_id) as rn, count(*) over () as n from p_events)
    select transaction_id, rn <= floor(n * 0.75) as is_train from o""")
def _(spark, sf_dir):
    older, newer = scoring.time_split(mapping.event_transactions(spark, sf_dir))
    return older.select("transaction_id", F.lit(True).alias("is_train")).unionAll(
        newer.select("transaction_id", F.lit(False).alias("is_train")))


@query("time_split_ties", """
    with o as (select c_custkey, row_number() over (order by c_nationkey, c_custkey) as rn, count(*) over () as n from customer)
    select c_custkey, rn <= floor(n * 0.75) as is_train from o""")
def _(spark, sf_dir):
    """A time column with few values, so the cut falls inside one."""
    people = mapping.table(spark, sf_dir, "customer").select(
        "c_custkey", F.timestamp_seconds(F.col("c_nationkey")).alias("created_at"))
    older, newer = scoring.time_split(people, tie="c_custkey")
    return older.select("c_custkey", F.lit(True).alias("is_train")).unionAll(
        newer.select("c_custkey", F.lit(False).alias("is_train")))


@query("attach_features", """
    with online as (select user_id, count(*) as card_txn_count_5m, sum(cast(value as decimal(18,2)))::double as card_amount_sum_1h
                    from events where user_id % 4 <> 0 and event_type = 'view' group by 1)
    select e.event_id,
           case when e.event_id % 3 = 0 then 1 else o.card_txn_count_5m end as card_txn_count_5m,
           case when e.event_id % 3 = 0 then e.value else o.card_amount_sum_1h end as card_amount_sum_1h,
           case when e.event_id % 3 = 0 then 5.0::double when o.user_id % 2 = 1 then 7.0::double end as seconds_since_last_card_txn,
           case when e.event_id % 3 = 0 then 'request' when o.user_id is not null then 'online' else 'none' end as feature_source
    from events e left join online o on e.user_id = o.user_id""")
def _(spark, sf_dir):
    events = mapping.table(spark, sf_dir, "events")
    gap = F.when(F.col("card_token") % 2 == 1, 7.0).otherwise(-1.0)
    online = (events.where("user_id % 4 <> 0 and event_type = 'view'").groupBy(F.col("user_id").alias("card_token")).agg(
        F.count(F.lit(1)).alias("card_txn_count_5m"), F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("card_amount_sum_1h"))
        .withColumns({"seconds_since_last_card_txn": gap, "is_new_ip_country": F.lit(False), "merchant_amount_zscore": F.lit(0.0)}))
    sent = F.when(F.col("event_id") % 3 == 0, F.struct(
        F.lit(1).cast("bigint").alias("card_txn_count_5m"), F.col("value").alias("card_amount_sum_1h"),
        F.lit(5.0).alias("seconds_since_last_card_txn"), F.lit(True).alias("is_new_ip_country"),
        F.lit(0.0).alias("merchant_amount_zscore")))
    asked = events.select("event_id", F.col("user_id").alias("card_token"), sent.alias("features"))
    return scoring.attach_features(asked, online).select(
        "event_id", "card_txn_count_5m", "card_amount_sum_1h", "seconds_since_last_card_txn", "feature_source")


def _training(spark, sf_dir):
    facts = materialize(fct(spark, sf_dir).select(*feat.FACT_COLUMNS), "fct")
    return materialize(feat.ml_transaction_features(facts, TXN_AS_OF), "training")


@query("train_score")
def _(spark, sf_dir):
    """Train on the older mature rows and score every transaction."""
    rows = _training(spark, sf_dir)
    older, _newer = scoring.time_split(scoring.training_set(rows))
    model = scoring.train(older)
    return scoring.score(rows, model).select("transaction_id", "fraud_score", "decision", "model_version")


@query("train_and_compare")
def _(spark, sf_dir):
    run = scoring.train_and_compare(_training(spark, sf_dir))
    rows = [(k, float(v)) for k, v in run.metrics.items()] + [("promoted", float(run.promoted)), ("rows", float(run.rows))]
    return spark.createDataFrame(rows, "metric string, value double").unionAll(
        scoring.importances(run.model).select(F.concat(F.lit("importance/"), "feature").alias("metric"),
                                              F.col("importance").alias("value")))
