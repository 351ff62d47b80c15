"""Queries over drift and skew of the event features."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillwork.operators import drift
from tillwork.registry.base import query
from tillwork.registry.features import E_FEATURES, event_features
from tillwork.session import materialize

COMPARED = ("amount", "card_amount_sum_1h", "seconds_since_last_card_txn", "merchant_amount_zscore")


def long_sql(split: str) -> str:
    return E_FEATURES + f""",
split as ({split}),""" + _LONG


_LONG = """
long as (
  select reference, 'amount' as feature, cast(amount as double) as v from split
  union all select reference, 'card_txn_count_5m', cast(card_txn_count_5m as double) from split
  union all select reference, 'card_amount_sum_1h', cast(card_amount_sum_1h as double) from split
  union all select reference, 'seconds_since_last_card_txn', coalesce(seconds_since_last_card_txn, -1) from split
  union all select reference, 'merchant_amount_zscore', round(merchant_amount_zscore, 6) from split),
edges as (
  select feature, list_sort(list_distinct(quantile_cont(v, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9]))) as edges
  from long where reference group by 1),
spine as (select feature, unnest(range(len(edges) + 1)) as bucket from edges),
shares as (
  select s.feature, s.bucket, reference, coalesce(n, 0) / greatest(1, sum(coalesce(n, 0)) over (
           partition by s.feature, r.reference))::double as share
  from spine s cross join (values (true), (false)) r(reference)
  left join (select feature, reference, len(list_filter(edges, lambda e: e < v)) as bucket, count(*) as n
             from long join edges using (feature) group by all) c using (feature, bucket, reference))"""
D_LONG = long_sql("select *, label_mature as reference from e_features")
R_LONG = long_sql("""select *, true as reference from e_features where label_mature and transaction_id % 4 <> 0
    union all select *, false from e_features where transaction_id % 10 <> 0 and created_at >= timestamp '2024-01-20'""")


def _halves(spark, sf_dir):
    rows = materialize(event_features(spark, sf_dir).withColumn(
        "merchant_amount_zscore", F.round("merchant_amount_zscore", 6)), "features")
    return rows.where("label_mature"), rows.where("not label_mature")


@query("decile_edges", f"""with {D_LONG}
    select feature, i as position, round(edges[i], 6) as edge from (
      select feature, edges, unnest(range(1, len(edges) + 1)) as i from edges)""")
def _(spark, sf_dir):
    reference, _live = _halves(spark, sf_dir)
    edges = drift.decile_edges(reference)
    return (edges.select("feature", F.posexplode("edges").alias("position", "edge"))
            .select("feature", (F.col("position") + 1).cast("bigint").alias("position"), F.round("edge", 6).alias("edge")))


@query("bucket_shares", f"""with {D_LONG}
    select feature, cast(bucket as integer) as bucket, round(share, 9) as share from shares where not reference""")
def _(spark, sf_dir):
    reference, live = _halves(spark, sf_dir)
    shares = drift.bucket_shares(drift.long_features(live, drift.DRIFT_FEATURES), drift.decile_edges(reference))
    return shares.withColumn("share", F.round("share", 9))


@query("psi_drift", f"""with {D_LONG}
    select a.feature, round(sum((a.share - e.share) * ln((a.share + 1e-4) / (e.share + 1e-4))), 4) as psi
    from shares a join shares e on a.feature = e.feature and a.bucket = e.bucket
    where not a.reference and e.reference group by 1""")
def _(spark, sf_dir):
    return drift.psi(*_halves(spark, sf_dir))


@query("drift_report", f"""with {R_LONG}
    select feature, (select count(*) from split where not reference) as live_rows, psi from (
      select a.feature, round(sum((a.share - e.share) * ln((a.share + 1e-4) / (e.share + 1e-4))), 4) as psi
      from shares a join shares e on a.feature = e.feature and a.bucket = e.bucket
      where not a.reference and e.reference group by 1)""")
def _(spark, sf_dir):
    """One in four rows was not approved, one in ten of the streamed rows came late."""
    i = F.col("transaction_id")
    rows = materialize(event_features(spark, sf_dir).withColumns({
        "merchant_amount_zscore": F.round("merchant_amount_zscore", 6), "is_approved": i % 4 != 0,
        "is_late": i % 10 == 0, "processed_at": F.col("created_at")}), "features")
    return drift.drift_report(rows, rows, F.expr("timestamp_ntz'2024-01-20 00:00:00'"))


S_SKEW = E_FEATURES + """,
offline as (select * replace (round(merchant_amount_zscore, 6) as merchant_amount_zscore) from e_features),
online as (select * replace (
    case when transaction_id % 5 = 0 then merchant_amount_zscore + 0.5 else merchant_amount_zscore end as merchant_amount_zscore,
    case when transaction_id % 7 = 0 then null else seconds_since_last_card_txn end as seconds_since_last_card_txn,
    card_txn_count_5m + case when transaction_id % 11 = 0 then 1 else 0 end as card_txn_count_5m)
  from offline where transaction_id % 13 <> 0),
diffs as (
  select 'card_txn_count_5m' as feature, 0.0 as tolerance, abs(o.card_txn_count_5m - f.card_txn_count_5m)::double as diff
    from online o join offline f using (transaction_id)
  union all select 'card_amount_sum_1h', 0.01, abs(o.card_amount_sum_1h::double - f.card_amount_sum_1h::double)
    from online o join offline f using (transaction_id)
  union all select 'seconds_since_last_card_txn', 1.0,
    abs(coalesce(o.seconds_since_last_card_txn, -1) - coalesce(f.seconds_since_last_card_txn, -1))
    from online o join offline f using (transaction_id)
  union all select 'is_new_ip_country', 0.0, abs(o.is_new_ip_country::integer - f.is_new_ip_country::integer)::double
    from online o join offline f using (transaction_id)
  union all select 'merchant_amount_zscore', 0.01, abs(o.merchant_amount_zscore - f.merchant_amount_zscore)
    from online o join offline f using (transaction_id))"""


@query("skew_report", f"""with {S_SKEW}
    select feature, round(avg(case when diff <= tolerance then 1.0 else 0.0 end), 9) as match_rate,
           round(median(diff), 6) as median_diff, round(max(diff), 6) as max_diff from diffs group by 1""")
def _(spark, sf_dir):
    """Streamed rows with known disturbances, late copies and repeats, against the batch features."""
    offline = materialize(event_features(spark, sf_dir).withColumn(
        "merchant_amount_zscore", F.round("merchant_amount_zscore", 6)), "features")
    i = F.col("transaction_id")
    seen = offline.where(i % 13 != 0).withColumns({
        "merchant_amount_zscore": F.col("merchant_amount_zscore") + F.when(i % 5 == 0, 0.5).otherwise(0.0),
        "seconds_since_last_card_txn": F.when(i % 7 != 0, F.col("seconds_since_last_card_txn")),
        "card_txn_count_5m": F.col("card_txn_count_5m") + F.when(i % 11 == 0, 1).otherwise(0),
        "is_late": F.lit(False), "processed_at": F.col("created_at")})
    again = seen.withColumns({"processed_at": F.col("created_at") + F.expr("interval 1 hour"),
                              "card_txn_count_5m": F.lit(99).cast("bigint")})
    late = seen.withColumns({"is_late": F.lit(True), "processed_at": F.col("created_at") - F.expr("interval 1 hour")})
    report = drift.skew_report(seen.unionByName(again).unionByName(late), offline)
    return report.select("feature", F.round("match_rate", 9).alias("match_rate"),
                         F.round("median_diff", 6).alias("median_diff"), F.round("max_diff", 6).alias("max_diff"))
