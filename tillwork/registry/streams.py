"""Queries that replay the events through the streaming job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwork.registry.base import features_sql, query
from tillwork.session import scratch_path
from tillwork.streaming import events as source
from tillwork.streaming import feature_sink as sinks
from tillwork.streaming import feature_stream as job

DRAIN_SECONDS = 1800
BATCHES, FILES = 5, 4       # micro-batches of a replay, and files of each at least
FILE_ROWS = 250_000         # messages of a file, so that the tasks that read a micro-batch grow with it


def messages(spark, sf_dir) -> DataFrame:
    """The events table as raw messages. Some events are sent again soon after (repeats), some much
    later (late), and some with an unreadable amount."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    i = F.col("event_id")

    def copy(when, offset, bad=False):
        return F.when(when, F.struct((i * 10 + offset).alias("offset"), F.lit(bad).alias("bad")))

    copies = F.array_compact(F.array(copy(F.lit(True), 0), copy(i % 100 == 0, 15), copy(i % 137 == 0, 2742),
                                     copy(i % 211 == 0, 3, True)))
    sent = rows.select("*", F.explode(copies).alias("c"))
    k = F.get_json_object("props", "$.k").cast("int")
    message = F.to_json(F.struct(
        F.col("event_id").cast("string").alias("transaction_id"), F.col("user_id").cast("string").alias("card_token"),
        F.col("event_type").alias("merchant_id"),
        F.when(F.col("c.bad"), "n/a").otherwise(F.col("value").cast("string")).alias("amount"),
        F.lit("CAD").alias("currency"), F.lit("ecommerce").alias("entry_mode"),
        F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("created_at"),
        F.when(~F.col("event_type").isin("click", "view"), (k % 5).cast("string")).alias("ip_country")))
    return sent.select(message.alias("value"), (F.col("user_id") % 3).cast("int").alias("part"), F.col("c.offset").alias("offset"))


def publish(sent: DataFrame, folder: str, batches=range(BATCHES)) -> int:
    """Add some of BATCHES slices of the messages, in order of their offsets, to a folder. Returns the
    number of files of a slice."""
    low, high, rows = sent.agg(F.min("offset"), F.max("offset"), F.count(F.lit(1))).first()
    files = max(FILES, -(-rows // (BATCHES * FILE_ROWS)))
    place = F.floor((F.col("offset") - (low or 0)) * BATCHES / ((high or 0) - (low or 0) + 1))
    for k in batches:
        sent.where(place == k).repartition(files).write.mode("append").parquet(folder)
    return files


def stream_of(sent: DataFrame, folder: str | None = None, files: int = FILES) -> DataFrame:
    """Messages as a stream of one micro-batch a slice; those of `folder` (`files` a slice), if given, else all."""
    if folder is None:
        folder = scratch_path(sent.sparkSession, "messages")
        files = publish(sent, folder)
    return source.event_stream(sent.sparkSession, "parquet", {"path": folder, "maxFilesPerTrigger": str(files)}, sent.schema)


def replay(spark, sf_dir) -> DataFrame:
    return stream_of(messages(spark, sf_dir))


_jobs: dict[tuple[str, str], str] = {}


def feature_job(spark, sf_dir) -> str:
    """The folder of the feature job run over the events: features, moments, outcomes, online rows. The
    queries below look at different outputs of one run, so a session runs it once for a table."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _jobs:
        path, sent = scratch_path(spark, "feature-job"), messages(spark, sf_dir)
        # Stopped half-way and started anew: the second run goes on from the checkpoint and the carried moments.
        for part in (range(BATCHES // 2), range(BATCHES // 2, BATCHES)):
            files = publish(sent, f"{path}/messages", part)
            valid, _invalid = source.parse_events(stream_of(sent, f"{path}/messages", files))
            sink = sinks.FeatureSink(path, also=[job.serve_latest(f"{path}/online")])
            running = job.write_features(job.feature_stream(valid), sink, f"{path}/checkpoint", available_now=True)
            if not running.awaitTermination(DRAIN_SECONDS):
                running.stop()
                raise TimeoutError("feature job did not finish")
        _jobs[key] = path
    return _jobs[key]


def drain(stream: DataFrame, label: str):
    """Run a stream over all its input and return (rows, query)."""
    spark = stream.sparkSession
    path = scratch_path(spark, label)
    running = (stream.writeStream.format("parquet").option("path", path)
               .option("checkpointLocation", scratch_path(spark, f"{label}-checkpoint"))
               .outputMode("append").trigger(availableNow=True).start())
    if not running.awaitTermination(DRAIN_SECONDS):
        running.stop()
        raise TimeoutError(f"stream {label} did not finish")
    return spark.read.schema(stream.schema).parquet(path), running


T_SENT = """
sent as (
  select e.*, cast(user_id % 3 as integer) as part, event_id * 10 + o as "offset", bad
  from events e, (select * from (values (0, false), (15, false), (2742, false), (3, true)) c(o, bad)) c
  where o = 0 or (o = 15 and event_id % 100 = 0) or (o = 2742 and event_id % 137 = 0) or (o = 3 and event_id % 211 = 0)),
tagged as (
  select *, coalesce(ts < max(ts) over (partition by part order by "offset" rows between unbounded preceding
                                       and 1 preceding) - interval 600 second, false) as is_late
  from sent where not bad),
kept as (
  select unnest(first) from (select min_by(t, "offset") as first from tagged t where not is_late group by event_id)),
""" + features_sql("kept", "event_id", "user_id", "ts", "value", "event_type",
                   "case when event_type not in ('click','view') then cast(json_extract_string(props, '$.k') as integer) % 5 end",
                   '"offset"', "3599999999 microseconds").lstrip() + """,
on_time as (
  select cast(event_id as varchar) as transaction_id, cast(user_id as varchar) as card_token, event_type as merchant_id,
         false as is_late, value as amount, ts as event_time, n5 as card_txn_count_5m, round(s1h, 4) as card_amount_sum_1h,
         gap as seconds_since_last_card_txn, flag as is_new_ip_country, round(z, 6) as merchant_amount_zscore
  from kept join feats on id = event_id),
offline as (
  select * from on_time
  union all
  select cast(event_id as varchar), cast(user_id as varchar), event_type, true, value, ts, null, null, null, null, null
  from tagged where is_late)"""

SHOWN = ("transaction_id", "card_token", "merchant_id", "is_late", "amount", "event_time", "card_txn_count_5m",
         "card_amount_sum_1h", "seconds_since_last_card_txn", "is_new_ip_country", "merchant_amount_zscore")


@query("stream_features", f"with {T_SENT} select * from offline")
def _(spark, sf_dir):
    rows = sinks.features(spark, feature_job(spark, sf_dir))
    return rows.select(*SHOWN).withColumns({
        "card_amount_sum_1h": F.round("card_amount_sum_1h", 4), "merchant_amount_zscore": F.round("merchant_amount_zscore", 6),
        "event_time": F.col("event_time").cast("timestamp_ntz")})


@query("stream_late", f"""with {T_SENT}
    select cast(event_id as varchar) as transaction_id, "offset", is_late from tagged""")
def _(spark, sf_dir):
    valid, _invalid = source.parse_events(replay(spark, sf_dir))
    # The stateful step hands every column to Python and back, so only what is shown goes in.
    held = valid.select("transaction_id", "part", "offset", "event_time")
    rows, _query = drain(job.tag_late(held).select("transaction_id", "offset", "is_late"), "late")
    return rows


@query("stream_dedupe", """
    select cast(event_id as varchar) as transaction_id, cast(ts as timestamp) as event_time from events""")
def _(spark, sf_dir):
    """Every event once, however late it comes."""
    valid, _invalid = source.parse_events(replay(spark, sf_dir))
    rows, _query = drain(job.dedupe_events(valid, within=None).select("transaction_id", "event_time"), "dedupe")
    return rows.withColumn("event_time", F.col("event_time").cast("timestamp_ntz"))


@query("stream_invalid", f"""with {T_SENT} select part, "offset" from sent where bad""")
def _(spark, sf_dir):
    _valid, invalid = source.parse_events(replay(spark, sf_dir))
    rows, _query = drain(invalid.select("part", "offset"), "invalid")
    return rows


@query("stream_outcomes", f"""with {T_SENT}
    select 'processed' as outcome, count(*) as n from kept
    union all select 'late', count(*) from tagged where is_late
    union all select 'invalid', count(*) from sent where bad
    union all select 'duplicate', (select count(*) from tagged where not is_late) - (select count(*) from kept)""")
def _(spark, sf_dir):
    read, _query = drain(source.decode(replay(spark, sf_dir)).select("valid"), "messages")
    return job.outcomes(read, sinks.features(spark, feature_job(spark, sf_dir)))


@query("online_features", f"""with {T_SENT}
    select transaction_id, card_token, card_txn_count_5m, card_amount_sum_1h from on_time
    qualify row_number() over (partition by card_token order by event_time desc, transaction_id desc) = 1""")
def _(spark, sf_dir):
    online = job.online_view(spark, f"{feature_job(spark, sf_dir)}/online")
    return online.select("transaction_id", "card_token", "card_txn_count_5m", F.round("card_amount_sum_1h", 4).alias("card_amount_sum_1h"))


@query("stream_moments", f"""with {T_SENT}
    select event_type as merchant_id, count(*) as n, round(avg(value), 6) as mean, round(var_samp(value), 4) as variance
    from kept group by event_type""")
def _(spark, sf_dir):
    """The moments that the last batch carried on."""
    path = feature_job(spark, sf_dir)
    last = spark.read.parquet(f"{path}/moments").agg(F.max("batch")).first()[0]
    moments = spark.read.parquet(f"{path}/moments").where(F.col("batch") == last)
    return moments.select("merchant_id", "n", F.round("mean", 6).alias("mean"), F.round(F.when(F.col("n") > 1, F.col("m2") / (F.col("n") - 1)), 4).alias("variance"))


@query("stream_outcome_metrics", f"""with {T_SENT}
    select 'processed' as outcome, count(*)::double as value from kept
    union all select 'late', count(*) from tagged where is_late
    union all select 'scored', 0 union all select 'failed', 0""")
def _(spark, sf_dir):
    """The metrics of all batches together."""
    metrics = sinks.outcome_metrics(spark, feature_job(spark, sf_dir))
    return metrics.groupBy(F.col("labels")["outcome"].alias("outcome")).agg(F.sum("value").alias("value"))


@query("stream_fail_open", f"""with {T_SENT}
    select cast(event_id as varchar) as transaction_id, is_late, fraud_score, score_error from (
        select event_id, false as is_late, null::double as fraud_score, 'ValueError: no model' as score_error from kept
        union all select event_id, true, null, 'ValueError: no model' from tagged where is_late)""")
def _(spark, sf_dir):
    """A model that fails leaves the stream running and its rows without a score."""
    def broken(rows):
        raise ValueError("no model")

    path = scratch_path(spark, "fail-open")
    valid, _invalid = source.parse_events(replay(spark, sf_dir))
    running = job.write_features(job.feature_stream(valid), sinks.FeatureSink(path, score=broken), f"{path}/checkpoint", available_now=True)
    if not running.awaitTermination(DRAIN_SECONDS):
        running.stop()
        raise TimeoutError("stream did not finish")
    return sinks.features(spark, path).select("transaction_id", "is_late", "fraud_score", "score_error")


@query("stream_dedupe_ttl", f"""with {T_SENT},
    again as (
        select event_id, ts + (h * interval 1 hour) as ts, event_id * 10 + o as "offset"
        from (select event_id, ts from events where event_id % 7 = 0) e, (values (0, 0), (1, 3), (5, 5), (9, 7)) c(h, o)),
    -- Two hours are remembered: a repeat within them is dropped, one after them counts as a transaction and starts anew.
    walked as (
        select event_id, list(ts order by "offset") as times from again group by event_id),
    chosen as (
        select event_id, unnest(list_reduce(list_prepend([times[1]], list_transform(times[2:], lambda t: [t])),
                   lambda a, x: case when x[1] <= a[len(a)] + interval 2 hour then a else a || x end)) as ts from walked)
    select cast(event_id as varchar) as transaction_id, ts as event_time from chosen""")
def _(spark, sf_dir):
    """Every seventh event sent again 1, 5 and 9 hours later, one after the other, when two hours of ids are remembered."""
    i = F.col("event_id")
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").where(i % 7 == 0)
    copies = F.array(*[F.struct(F.lit(h).alias("h"), F.lit(o).alias("o")) for h, o in ((0, 0), (1, 3), (5, 5), (9, 7))])
    sent = rows.select("event_id", "event_type", "value", (i * 10).alias("first"), "ts", F.explode(copies).alias("c"))
    later = F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + F.col("c.h") * 3_600_000_000)
    # Every event is a source partition and a card of its own, so that only repeats decide.
    message = F.to_json(F.struct(
        i.cast("string").alias("transaction_id"), i.cast("string").alias("card_token"), F.col("event_type").alias("merchant_id"),
        F.col("value").cast("string").alias("amount"), F.lit("CAD").alias("currency"), F.lit("chip").alias("entry_mode"),
        F.date_format(later, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("created_at")))
    sent = sent.select(message.alias("value"), i.cast("int").alias("part"), (F.col("first") + F.col("c.o")).alias("offset"))
    valid, _invalid = source.parse_events(stream_of(sent))
    rows, _query = drain(job.card_features(job.tag_late(valid), dedupe_seconds=7200).select("transaction_id", "event_time"), "dedupe-ttl")
    return rows.withColumn("event_time", F.col("event_time").cast("timestamp_ntz"))
