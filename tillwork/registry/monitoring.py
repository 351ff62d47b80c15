"""Queries over service-level indicators, alerts and logs derived from the events."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillwork.operators.dedupe import top_n
from tillwork.plans import monitoring as plan
from tillwork.registry.base import query
from tillwork.sources import mapping


@query("ratio_sli", """
    with steps as (select (epoch_us(ts) // 300000000) * 300 as "at", count(*) as n,
                          count(*) filter (where event_type <> 'error') as ok from events group by 1)
    select "at", cast(sum(ok) over w as bigint) as good, cast(sum(n) over w as bigint) as total,
           round(sum(ok) over w / sum(n) over w, 9) as ratio
    from steps window w as (order by "at" range between 3300 preceding and current row)""")
def _(spark, sf_dir):
    events = mapping.table(spark, sf_dir, "events")
    return plan.ratio_sli(events, "ts", F.col("event_type") != "error", 3600, 300).withColumn("ratio", F.round("ratio", 9))


@query("latency_buckets", """
    select event_type, le, count(*) filter (where value <= le) as n
    from events, (select unnest([1.0, 5.0, 10.0, 50.0, 100.0, 'inf'::double]) as le) group by 1, 2""")
def _(spark, sf_dir):
    return plan.histogram(mapping.table(spark, sf_dir, "events"), "value", (1, 5, 10, 50, 100), ["event_type"])


@query("histogram_quantile", """
    with b as (select event_type, le, count(*) filter (where value <= le) as n
               from events, (select unnest([1.0, 5.0, 10.0, 50.0, 100.0, 'inf'::double]) as le) group by 1, 2),
    r as (select *, lag(n, 1, 0) over w as below, lag(le) over w as prev, max(n) over (partition by event_type) * 0.9::double as rank
          from b window w as (partition by event_type order by le)),
    f as (select *, row_number() over (partition by event_type order by le) as i from r where n >= rank)
    select event_type, round(case when le = 'inf'::double then prev
                                  else coalesce(prev, 0) + (le - coalesce(prev, 0)) * (rank - below) / (n - below) end, 6) as quantile
    from f where i = 1""")
def _(spark, sf_dir):
    buckets = plan.histogram(mapping.table(spark, sf_dir, "events"), "value", (1, 5, 10, 50, 100), ["event_type"])
    return plan.histogram_quantile(buckets, 0.9, ["event_type"]).withColumn("quantile", F.round("quantile", 6))


# Metric samples: each event contributes a sample of one series, chosen by its id.
SERIES = (
    ("freshness_seconds", "mart", 20), ("freshness_seconds", "raw", 15), ("freshness_seconds", "source", 10),
    ("check_success", "warehouse", None), ("budget_left", "ingest_duration", 0.01), ("slo_sli_24h", "ingest_duration", 0.005),
    ("slo_objective", "ingest_duration", "0.99"), ("cost_usd", "24h", 0.1), ("cost_usd", "7d", 0.3),
    ("ledger_age_days", "all", 0.3), ("busy_ratio", "all", 0.01), ("consumer_up", "c0", None), ("consumer_lag", "p0", 5),
    ("scorer_up", "s0", None), ("scorer_availability", "all", 0.02), ("scorer_p99_seconds", "all", 0.001),
    ("model_version", "s0", 0.01), ("review_rate", "all", 0.001), ("feature_psi", "amount", 0.005),
)


def _series_value(scale, value, sql):
    if scale is None:
        return "case when event_type = 'error' then 0.0 else 1.0 end"
    if isinstance(scale, str):
        return f"cast({scale} as double)"
    return f"cast({value} as double) * cast({scale} as double)"


_N = len(SERIES)
_CASE = {k: "case event_id % {n} {w} end".format(n=_N, w=" ".join(
    f"when {i} then {f(s)}" for i, s in enumerate(SERIES))) for k, f in {
        "metric": lambda s: f"'{s[0]}'", "label": lambda s: f"'{s[1]}'",
        "value": lambda s: _series_value(s[2], "value", True)}.items()}

M_SAMPLES = f"""
samples as (select date_trunc('day', ts) as "at", {_CASE['metric']} as metric, {_CASE['label']} as label,
                   {_CASE['value']} as value from events)"""


def samples(spark, sf_dir):
    return mapping.table(spark, sf_dir, "events").select(
        F.date_trunc("day", "ts").cast("timestamp_ntz").alias("at"),
        *[F.expr(_CASE[k]).alias(k) for k in ("metric", "label", "value")])


M_STATES = M_SAMPLES + """,
wide as (
  select "at",
    max(value) filter (where metric = 'freshness_seconds' and label = 'mart') as mart,
    max(value) filter (where metric = 'freshness_seconds' and label = 'raw') as raw,
    max(value) filter (where metric = 'freshness_seconds' and label = 'source') as source,
    max(value) filter (where metric = 'cost_usd' and label = '24h') as day_cost,
    max(value) filter (where metric = 'cost_usd' and label = '7d') as week_cost,
    max(value) filter (where metric = 'ledger_age_days') as age, max(value) filter (where metric = 'busy_ratio') as busy,
    min(value) filter (where metric = 'consumer_up') as consumer_up, sum(value) filter (where metric = 'consumer_lag') as lag_,
    sum(value) filter (where metric = 'scorer_up') as scorer_up, max(value) filter (where metric = 'scorer_availability') as avail,
    max(value) filter (where metric = 'scorer_p99_seconds') as p99,
    max(value) filter (where metric = 'model_version') as newest, min(value) filter (where metric = 'model_version') as oldest,
    max(value) filter (where metric = 'review_rate') as review,
    min(value) filter (where metric = 'check_success') as chk, min(value) filter (where metric = 'budget_left') as budget,
    min(value) filter (where metric = 'slo_sli_24h') as sli, max(value) filter (where metric = 'slo_objective') as objective,
    max(value) filter (where metric = 'feature_psi') as psi
  from samples group by 1),
rules as (
  select "at", 'MartDataStale' as alert, null as subject, 'page' as severity, coalesce(mart > 900, false) as active from wide
  union all select "at", 'IngestionStalled', null, 'page', coalesce(raw - source > 900, false) from wide
  union all select "at", 'TransformStalled', null, 'page', coalesce(mart - raw > 900, false) from wide
  union all select "at", 'SourceQuiet', null, 'ticket', coalesce(source > 900, false) from wide
  union all select "at", 'EltCostSpike', null, 'ticket', coalesce(day_cost > 1.5 * week_cost / 7 and age >= 7, false) from wide
  union all select "at", 'EltWriterSaturated', null, 'ticket', coalesce(busy > 0.7, false) from wide
  union all select "at", 'ConsumerDown', null, 'page', coalesce(consumer_up = 0, false) from wide
  union all select "at", 'ConsumerLagHigh', null, 'page', coalesce(lag_ > 1000, false) from wide
  union all select "at", 'ScorerDown', null, 'page', scorer_up is null or scorer_up < 1 from wide
  union all select "at", 'ScorerErrorRate', null, 'page', coalesce(1 - avail > 0.001, false) from wide
  union all select "at", 'ScorerLatencyHigh', null, 'ticket', coalesce(p99 > 0.05, false) from wide
  union all select "at", 'ModelVersionsDiverged', null, 'ticket', coalesce(newest > oldest, false) from wide
  union all select "at", 'ReviewRateHigh', null, 'ticket', coalesce(review > 0.05, false) from wide
  union all select "at", 'FreshnessCheckFailing', 'warehouse', 'ticket', chk = 0 from wide where chk is not null
  union all select "at", 'EltErrorBudgetLow', 'ingest_duration', 'ticket', budget < 0.25 from wide where budget is not null
  union all select "at", 'EltErrorBudgetBurnFast', 'ingest_duration', 'page', (1 - sli) > 15 * (1 - objective) from wide
    where sli is not null and objective is not null
  union all select "at", 'FeatureDrift', 'amount', 'ticket', psi > 0.25 from wide where psi is not null)"""


@query("alert_rules", f"with {M_STATES} select * from rules")
def _(spark, sf_dir):
    return plan.evaluate_rules(samples(spark, sf_dir))


M_SUSTAINED = M_STATES + """,
marked as (select *, case when active and not coalesce(lag(active) over w, false) then "at" end as began
           from rules window w as (partition by alert, subject order by "at")),
alerts as (
  select "at", alert, subject, severity, active,
    case when not active then 'inactive'
         when "at" - max(began) over (partition by alert, subject order by "at") >= interval 1 day then 'firing'
         else 'pending' end as state from marked)"""


@query("alert_sustained", f"with {M_SUSTAINED} select * from alerts")
def _(spark, sf_dir):
    """Samples are a day apart, longer than any rule must hold, so the second active one fires."""
    return plan.sustained(plan.evaluate_rules(samples(spark, sf_dir)))


@query("alert_list", f"""with {M_SUSTAINED}
    select * from alerts where state <> 'inactive' and "at" = (select max("at") from alerts)""")
def _(spark, sf_dir):
    return plan.alert_list(plan.sustained(plan.evaluate_rules(samples(spark, sf_dir))))


@query("score_distribution", """
    select le, count(*) filter (where s <= le) as n
    from (select least(value / 100, 1.0) as s from events),
         (select unnest([0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1.0,'inf'::double]) as le) group by 1""")
def _(spark, sf_dir):
    scored = mapping.table(spark, sf_dir, "events").select(F.least(F.col("value") / 100, F.lit(1.0)).alias("fraud_score"))
    return plan.score_distribution(scored)


@query("decision_counts", """
    select case when value >= 50 then 'review' else 'approve' end as decision,
           case when user_id % 3 = 0 then 'none' else 'online' end as feature_source, count(*) as n
    from events group by 1, 2""")
def _(spark, sf_dir):
    return plan.decision_counts(mapping.table(spark, sf_dir, "events").select(
        F.when(F.col("value") >= 50, "review").otherwise("approve").alias("decision"),
        F.when(F.col("user_id") % 3 == 0, "none").otherwise("online").alias("feature_source")))


def check_log(spark, sf_dir):
    up = F.when(F.col("event_type") == "error", 0).otherwise(1)
    return mapping.table(spark, sf_dir, "events").select(
        F.concat(F.lit("service-"), (F.col("user_id") % 6).cast("string")).alias("service"),
        F.unix_seconds(F.col("ts").cast("timestamp")).alias("ts"), up.alias("up"), F.col("value").alias("latency_ms"),
        F.when(up == 0, F.col("props")).alias("error"))


C_LOG = """
checks as (select concat('service-', cast(user_id % 6 as varchar)) as service, epoch_us(ts) // 1000000 as ts,
                  case when event_type = 'error' then 0 else 1 end as up, value as latency_ms,
                  case when event_type = 'error' then props end as error from events)"""


@query("uptime_current", f"""with {C_LOG}
    select * from checks c where ts = (select max(ts) from checks d where d.service = c.service)""")
def _(spark, sf_dir):
    return plan.uptime_current(check_log(spark, sf_dir))


END = 1706572800  # 2024-01-30 00:00:00 UTC


C_HISTORY = C_LOG + f""",
bars as (
  select s.service, b.bar, c.checks, c.up, c.error, c.up / c.checks as uptime
  from (select distinct service from checks where ts >= {END} - 604800) s
  cross join (select cast(unnest(range(84)) as integer) as bar) b
  left join (select service, (ts - ({END} - 604800)) // 7200 as bar, count(*) as checks, cast(sum(up) as bigint) as up,
                    max(case when up = 0 then error end) as error
             from checks where ts >= {END} - 604800 group by 1, 2) c on c.service = s.service and c.bar = b.bar)"""


@query("uptime_history", f"with {C_HISTORY} select service, bar, checks, up, error, round(uptime, 9) as uptime from bars")
def _(spark, sf_dir):
    return plan.uptime_history(check_log(spark, sf_dir), END, *plan.UPTIME_RANGES["7d"]).withColumn(
        "uptime", F.round("uptime", 9))


@query("uptime_total", f"""with {C_HISTORY}
    select service, cast(sum(checks) as bigint) as checks, cast(sum(up) as bigint) as up,
           round(sum(up) / sum(checks), 9) as uptime from bars group by 1""")
def _(spark, sf_dir):
    history = plan.uptime_history(check_log(spark, sf_dir), END, *plan.UPTIME_RANGES["7d"])
    return plan.uptime_total(history).withColumn("uptime", F.round("uptime", 9))


R_LOG = """
log as (select case when event_type = 'error' then 'error' else 'ok' end as status, value as latency_ms,
               case when event_type = 'error' then concat('code ', cast(user_id % 4 as varchar))
                    else concat('v', cast(user_id % 3 as varchar)) end as detail from events)"""


def request_log(spark, sf_dir):
    failed = F.col("event_type") == "error"
    return mapping.table(spark, sf_dir, "events").select(
        F.when(failed, "error").otherwise("ok").alias("status"), F.col("value").alias("latency_ms"),
        F.when(failed, F.concat(F.lit("code "), (F.col("user_id") % 4).cast("string")))
        .otherwise(F.concat(F.lit("v"), (F.col("user_id") % 3).cast("string"))).alias("detail"))


@query("request_summary", f"""with {R_LOG},
    s as (select list_sort(list(latency_ms)) as l from log where status = 'ok')
    select count(*) as requests, count(*) filter (where status = 'ok') as ok,
           count(*) filter (where status <> 'ok') as failed,
           count(*) filter (where status <> 'ok') / count(*)::double as failed_share,
           (select l[len(l) // 2 + 1] from s) as p50_ms, (select l[cast(floor(len(l) * 0.99) as bigint) + 1] from s) as p99_ms
    from log""")
def _(spark, sf_dir):
    return plan.request_summary(request_log(spark, sf_dir))


@query("request_breakdown", f"with {R_LOG} select status, detail, count(*) as n from log group by 1, 2")
def _(spark, sf_dir):
    return plan.request_breakdown(request_log(spark, sf_dir))


@query("latency_histogram", """
    with w as (select greatest(0, value - 10) as seconds from events where event_id % 9 <> 0)
    select le, count(*) filter (where seconds <= le) as n
    from w, (select unnest([0.1, 0.5, 1.0, 2.0, 5.0, 10.0, 30.0, 60.0, 300.0, 'inf'::double]) as le) group by 1""")
def _(spark, sf_dir):
    """Processing delays taken from the values, some of them before the event time."""
    delay = F.round((F.col("value") - 10) * 1_000_000).cast("bigint")
    at = F.col("ts").cast("timestamp")
    rows = mapping.table(spark, sf_dir, "events").select(
        (F.col("event_id") % 9 == 0).alias("is_late"), at.alias("event_time"),
        F.timestamp_micros(F.unix_micros(at) + delay).alias("processed_at"))
    return plan.latency_histogram(rows)


@query("top_events", """
    select user_id, event_id, value from events order by value desc, event_id limit 20""")
def _(spark, sf_dir):
    return top_n(mapping.table(spark, sf_dir, "events").select("user_id", "event_id", "value"),
                 [F.col("value").desc(), F.col("event_id")], 20)
