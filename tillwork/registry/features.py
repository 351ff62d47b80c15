"""Queries over the point-in-time features."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwork.functions import scalars
from tillwork.operators.dedupe import latest_by
from tillwork.plans import features as feat
from tillwork.registry.base import P_EVENTS, P_FCT, P_STG, features_sql, query
from tillwork.registry.payments import fct
from tillwork.session import materialize
from tillwork.sources import mapping

AS_OF = date(2024, 3, 1)


def timed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.event_transactions(spark, sf_dir).withColumn("_at", scalars.micros("created_at"))


def event_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The training table over the event stream."""
    return (feat.windowed_features(mapping.event_transactions(spark, sf_dir))
            .withColumn("transaction_date", F.to_date("created_at"))
            .withColumn("label_mature", feat.label_mature("transaction_date", AS_OF)))


E_FEATURES = P_EVENTS + "," + features_sql("p_events", "transaction_id", "card_token", "created_at", "amount", "merchant_id", "ip_country") + """,
e_features as (
  select transaction_id, card_token, merchant_id, amount, created_at, label, n5 as card_txn_count_5m, s1h as card_amount_sum_1h,
         gap as seconds_since_last_card_txn, flag as is_new_ip_country, z as merchant_amount_zscore,
         cast(created_at as date) as transaction_date, cast(created_at as date) <= date '2024-03-01' - 45 as label_mature
  from p_events join feats on id = transaction_id)"""


@query("card_window_features", f"""
    with {P_EVENTS}
    select transaction_id, count(*) over five as card_txn_count_5m,
           cast(sum(amount) over hour as decimal(28,2)) as card_amount_sum_1h
    from p_events
    window five as (partition by card_token order by created_at
                    range between interval 300 seconds preceding and current row),
           hour as (partition by card_token order by created_at
                    range between interval 3600 seconds preceding and current row)""")
def _(spark, sf_dir):
    return feat.card_windows(timed_events(spark, sf_dir)).select(
        "transaction_id", "card_txn_count_5m", "card_amount_sum_1h")


@query("card_window_features_6h", f"""
    with {P_EVENTS}
    select transaction_id, count(*) over w as card_txn_count,
           cast(sum(amount) over w as decimal(28,2)) as card_amount_sum
    from p_events
    window w as (partition by card_token order by created_at
                 range between interval 21600 seconds preceding and current row)""")
def _(spark, sf_dir):
    wide = feat.card_windows(timed_events(spark, sf_dir), 21600, 21600)
    return wide.select("transaction_id", F.col("card_txn_count_5m").alias("card_txn_count"),
                       F.col("card_amount_sum_1h").alias("card_amount_sum"))


@query("card_gap", f"""
    with {P_EVENTS}
    select transaction_id, date_diff('microsecond', lag(created_at) over (
             partition by card_token order by created_at, transaction_id), created_at) / 1e6
           as seconds_since_last_card_txn
    from p_events""")
def _(spark, sf_dir):
    return feat.card_gap(timed_events(spark, sf_dir)).select("transaction_id", "seconds_since_last_card_txn")


@query("ip_country_flag", f"with {E_FEATURES} select transaction_id, is_new_ip_country from e_features")
def _(spark, sf_dir):
    return feat.new_country(timed_events(spark, sf_dir)).select("transaction_id", "is_new_ip_country")


@query("merchant_zscore", f"""
    with {E_FEATURES} select transaction_id, round(merchant_amount_zscore, 6) as merchant_amount_zscore
    from e_features""")
def _(spark, sf_dir):
    return feat.merchant_zscore(timed_events(spark, sf_dir)).select(
        "transaction_id", F.round("merchant_amount_zscore", 6).alias("merchant_amount_zscore"))


@query("event_features", f"""
    with {E_FEATURES}
    select transaction_id, card_token, merchant_id, created_at, label, card_txn_count_5m,
           cast(card_amount_sum_1h as decimal(28,2)) as card_amount_sum_1h, seconds_since_last_card_txn,
           is_new_ip_country, round(merchant_amount_zscore, 6) as merchant_amount_zscore, transaction_date,
           label_mature from e_features""")
def _(spark, sf_dir):
    return (event_features(spark, sf_dir).drop("amount", "ip_country")
            .withColumn("merchant_amount_zscore", F.round("merchant_amount_zscore", 6)))


TXN_AS_OF = date(1998, 9, 1)


@query("txn_features", f"""
    with {P_FCT}, {features_sql("p_fct", "transaction_id", "card_token", "created_at", "amount", "merchant_id", "ip_country")}
    select transaction_id, card_token, merchant_id, created_at, transaction_date, f.amount, currency, amount_cad,
           entry_mode, avs_result, cvv_result, three_ds_authenticated, network_risk_score, is_approved,
           n5 as card_txn_count_5m, cast(s1h as decimal(28,2)) as card_amount_sum_1h, gap as seconds_since_last_card_txn,
           flag as is_new_ip_country, has_fraud_chargeback as label, round(z, 6) as merchant_amount_zscore,
           transaction_date <= date '1998-09-01' - 45 as label_mature
    from p_fct f join feats on id = transaction_id""")
def _(spark, sf_dir):
    out = feat.ml_transaction_features(materialize(fct(spark, sf_dir).select(*feat.FACT_COLUMNS), "fct"), TXN_AS_OF)
    return out.withColumn("merchant_amount_zscore", F.round("merchant_amount_zscore", 6))


@query("zscore_near_amounts", f"""
    with {P_EVENTS},
    shifted as (select transaction_id, card_token, merchant_id, created_at, ip_country,
                       cast(1000000 + (transaction_id % 2) * 0.01 as decimal(18,2)) as amount from p_events),
    {features_sql("shifted", "transaction_id", "card_token", "created_at", "amount", "merchant_id", "ip_country")}
    select id as transaction_id, round(z, 6) as merchant_amount_zscore from feats""")
def _(spark, sf_dir):
    """Large amounts one cent apart."""
    near = F.lit(1000000) + (F.col("transaction_id") % 2) * F.lit(0.01)
    rows = timed_events(spark, sf_dir).withColumn("amount", near.cast("decimal(18,2)"))
    return feat.merchant_zscore(rows).select("transaction_id", F.round("merchant_amount_zscore", 6).alias("merchant_amount_zscore"))


@query("training_set", f"""
    with {P_FCT} select transaction_id, created_at from p_fct
    where is_approved and transaction_date <= date '1998-09-01' - 45""")
def _(spark, sf_dir):
    facts = fct(spark, sf_dir).withColumn("label_mature", feat.label_mature("transaction_date", TXN_AS_OF))
    return feat.training_set(facts).select("transaction_id", "created_at")


@query("feature_vector", f"""
    with {P_FCT}
    select transaction_id, cast(amount_cad as double) as amount_cad,
           cast(network_risk_score as double) as network_risk_score,
           cast(is_card_not_present as double) as is_card_not_present,
           case when avs_result in ('N','Z') then 1.0::double else 0.0::double end as avs_mismatch,
           case when cvv_result = 'N' then 1.0::double else 0.0::double end as cvv_mismatch,
           coalesce(cast(three_ds_authenticated as double), 'NaN'::double) as three_ds_authenticated
    from p_fct""")
def _(spark, sf_dir):
    """The raw-field part of the vector; the windowed part is in txn_features."""
    facts = fct(spark, sf_dir).drop("amount_cad")
    blank = facts.withColumns({name: F.lit(None).cast("double") for name in feat.WINDOWED})
    vector = feat.feature_vector(blank, mapping.fx_rates(spark))
    return vector.select("transaction_id", *[n for n in feat.FEATURES if n not in feat.WINDOWED])


@query("json_fields", """
    select event_id, json_extract_string(props, '$.k') as k, json_extract_string(props, '$.a.b') as nothing,
           cast(json_extract_string(props, '$.k') as integer) > 50 as k_high from events""")
def _(spark, sf_dir):
    return mapping.table(spark, sf_dir, "events").select(
        "event_id", scalars.json_field("props", "k").alias("k"), scalars.json_field("props", "a.b").alias("nothing"),
        (scalars.json_field("props", "k").cast("int") > 50).alias("k_high"))


@query("mask_columns", """
    select c_custkey, md5(lower(trim(concat(' ', c_name, '@Example.com ')))) as email_hash,
           right(c_name, 4) as last4 from customer""")
def _(spark, sf_dir):
    people = mapping.table(spark, sf_dir, "customer").withColumn(
        "email", F.concat(F.lit(" "), F.col("c_name"), F.lit("@Example.com ")))
    return people.select("c_custkey", scalars.mask_email("email").alias("email_hash"),
                         scalars.mask_last4("c_name").alias("last4"))


@query("merchant_moments", f"""
    with {P_EVENTS}
    select merchant_id, count(*) as n, round(avg(cast(amount as double)), 6) as mean,
           round(coalesce(var_samp(cast(amount as double)), 0) * (count(*) - 1), 3) as m2
    from p_events group by 1""")
def _(spark, sf_dir):
    return feat.merchant_moments(mapping.event_transactions(spark, sf_dir)).select(
        "merchant_id", "n", F.round("mean", 6).alias("mean"), F.round("m2", 3).alias("m2"))


@query("card_state", f"""
    with {P_EVENTS}
    select card_token, epoch_us(max(created_at)) as last_micros,
           array_to_string(list_sort(list(distinct ip_country) filter (where ip_country is not null)), ',')
             as ip_countries
    from p_events group by 1""")
def _(spark, sf_dir):
    return feat.card_state(mapping.event_transactions(spark, sf_dir)).withColumn(
        "ip_countries", F.array_join("ip_countries", ","))


@query("recent_transactions", f"""
    with {P_EVENTS}
    select transaction_id, card_token, amount, created_at from p_events
    where created_at >= (select max(created_at) from p_events) - interval 6 hour""")
def _(spark, sf_dir):
    return feat.recent(mapping.event_transactions(spark, sf_dir), span="6 hours").select(
        "transaction_id", "card_token", "amount", "created_at")


@query("flatten_event", f"""
    with {P_STG}
    select transaction_id, amount, currency, entry_mode, avs_result, cvv_result,
           cast(three_ds_authenticated as varchar) as three_ds_authenticated,
           cast(network_risk_score as varchar) as network_risk_score from p_stg""")
def _(spark, sf_dir):
    """Nested payloads of the newest copies as flat columns."""
    raw = mapping.raw_transactions(spark, sf_dir)
    newest = latest_by(raw, ["transaction_id"], [F.col("updated_at").desc(), F.col("id").desc()])
    nested = newest.select("transaction_id", "amount", F.upper("currency").alias("currency"), "entry_mode",
                           scalars.payload("raw_payload").alias("raw_payload"))
    return feat.flatten_event(nested)
