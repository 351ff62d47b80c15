"""The streaming feature job: tag late events, drop repeats, compute the card's features. The sink
(feature_sink.py) adds merchant and model scores and stores the rows."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tillwork.operators.dedupe import latest_by
from tillwork.plans.features import card_state, merchant_moments, recent
from tillwork.functions.scalars import micros
from tillwork.streaming import processors
from tillwork.streaming.processors import CardFeatures, LateTagger

# The stateful steps travel with the query, so no worker needs this package installed.
cloudpickle.register_pickle_by_value(processors)

ALLOWED_LATENESS_SECONDS = 600
DEDUPE_SECONDS = 24 * 3600
STATE_TTL_DAYS = 90
BUCKETS = 256       # of the keyed state; a checkpoint keeps the number it began with


def _mode(ttl_days: int | None) -> tuple[str, int | None]:
    """State expiry works in processing time only, and then a stream never runs dry: leave it out
    for runs over what is available now."""
    return ("none", None) if ttl_days is None else ("processingTime", ttl_days * 86_400_000)


def _with(schema: T.StructType, *added: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType(list(schema.fields) + [T.StructField(n, t) for n, t in added])


def tag_late(events: DataFrame, lateness_seconds: float = ALLOWED_LATENESS_SECONDS) -> DataFrame:
    """Add is_late. Late events are kept: the built-in watermark would drop them."""
    timed = events.withColumn("micros", F.unix_micros("event_time"))
    schema = _with(timed.schema, ("is_late", T.BooleanType()))
    return timed.withColumn("_bucket", F.expr(f"pmod(part, {BUCKETS})")).groupBy("_bucket").transformWithStateInPandas(
        LateTagger(lateness_seconds), schema, "append", "none")


def card_features(tagged: DataFrame, dedupe_seconds: int = DEDUPE_SECONDS, initial: DataFrame | None = None,
                  ttl_days: int | None = None) -> DataFrame:
    """One row per transaction with the card's features; repeats emit nothing. A repeat older than
    the allowed lateness is late, so any `dedupe_seconds` above that gives the same result for
    cards that stay in one source partition; a shorter one keeps less state."""
    mode, ttl = _mode(ttl_days)
    schema = _with(tagged.schema, ("card_txn_count_5m", T.LongType()), ("card_amount_sum_1h", T.DoubleType()),
                   ("seconds_since_last_card_txn", T.DoubleType()), ("is_new_ip_country", T.BooleanType()))
    bucket = F.expr(f"cast(pmod(xxhash64(card_token), {BUCKETS}) as int)")
    return tagged.withColumn("_bucket", bucket).groupBy("_bucket").transformWithStateInPandas(
        CardFeatures(dedupe_seconds, ttl), schema, "append", mode,
        initialState=None if initial is None else initial.withColumn("_bucket", bucket).groupBy("_bucket"))


def dedupe_events(events: DataFrame, within: str | None = "24 hours") -> DataFrame:
    """First event per transaction, for streams that need nothing else. Events that are later than `within`
    are dropped, as Spark's watermark has it. With None all are kept and all ids remembered, so the state
    grows with the number of transactions: for replays of a table."""
    if within is None:
        return events.dropDuplicates(["transaction_id"])
    return events.withWatermark("event_time", within).dropDuplicatesWithinWatermark(["transaction_id"])


def initial_state(fct: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(card state, merchant moments) from the transaction history, to start a new checkpoint with.
    A card's list holds its transactions of the last hour of data only."""
    hour = recent(fct).groupBy("card_token").agg(F.collect_list(F.struct(
        micros("created_at").alias("at"), F.col("amount").cast("double").alias("amount"),
        F.col("transaction_id").cast("string").alias("id"))).alias("r"))
    cards = card_state(fct).join(hour, "card_token", "left")
    none = F.array()
    cards = cards.select(
        "card_token", "last_micros", "ip_countries",
        F.coalesce("r.at", none.cast("array<bigint>")).alias("recent_at"),
        F.coalesce("r.amount", none.cast("array<double>")).alias("recent_amount"),
        F.coalesce("r.id", none.cast("array<string>")).alias("recent_id"))
    return cards, merchant_moments(fct)


def feature_stream(events: DataFrame, lateness_seconds: float = ALLOWED_LATENESS_SECONDS, cards: DataFrame | None = None,
                   dedupe_seconds: int = DEDUPE_SECONDS, ttl_days: int | None = None) -> DataFrame:
    """Valid events to rows with the card's features. The counts of each outcome are observed as
    `outcomes`. Pass ttl_days (STATE_TTL_DAYS) in a job that runs on."""
    rows = card_features(tag_late(events, lateness_seconds), dedupe_seconds, cards, ttl_days)
    return rows.withColumn("processed_at", F.current_timestamp()).observe(
        "outcomes", F.count_if(~F.col("is_late")).alias("processed"), F.count_if("is_late").alias("late"))


def write_features(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Run a feature stream into its sink. The checkpoint and the sink's numbered folders make each row
    appear once, also over restarts."""
    writer = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")).start()


def write_dead_letters(invalid: DataFrame, path: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    writer = (invalid.writeStream.format("parquet").option("path", path)
              .option("checkpointLocation", checkpoint).outputMode("append"))
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")).start()


def latest_features(rows: DataFrame) -> DataFrame:
    """Newest on-time feature row per card."""
    return latest_by(rows.where(~F.col("is_late")), ["card_token"], [F.col("event_time").desc(), F.col("transaction_id").desc()])


def serve_latest(path: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch sink for the newest feature row per card. Each batch adds one folder with the
    newest rows it saw, so the cost follows the batch and a repeated batch replaces its own folder;
    `online_view` reads across batches and `compact_online` merges old ones."""
    def write(batch: DataFrame, batch_id: int) -> None:
        latest_features(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id:012d}")
    return write


def online_view(spark: SparkSession, path: str) -> DataFrame:
    return latest_features(spark.read.option("mergeSchema", True).option("basePath", path).parquet(f"{path}/batch=*")).drop("batch")


def compact_online(spark: SparkSession, path: str) -> None:
    """Merge the folders present now into one. A crash before the old ones are gone leaves
    repeats, which the view resolves."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    old = [s.getPath() for s in fs.listStatus(root) if s.getPath().getName().startswith("batch=")]
    merged = latest_features(spark.read.option("basePath", path).parquet(*[str(p) for p in old])).drop("batch")
    merged.write.parquet(f"{path}/batch=merged-{uuid.uuid4().hex}")
    for folder in old:
        fs.delete(folder, True)


def outcomes(messages: DataFrame, features: DataFrame) -> DataFrame:
    """(outcome, n) over all of a stream's life, from the tables it wrote: one row per message with
    `valid`, and the feature rows with `is_late`. What was neither invalid, late nor processed was a
    repeat. A query's progress reports cover its last batches only, so they are not used."""
    read = messages.agg(F.count(F.lit(1)).alias("total"), F.count_if(~F.col("valid")).alias("invalid"))
    made = features.agg(F.count_if(~F.col("is_late")).alias("processed"), F.count_if("is_late").alias("late"))
    row = read.crossJoin(made).withColumn("duplicate", F.expr("total - invalid - processed - late"))   # one row each
    return row.unpivot([], ["processed", "late", "invalid", "duplicate"], "outcome", "n")


def source_lag(query: StreamingQuery) -> list[dict]:
    """How far each source was behind at the last batch: per topic and partition for sources that
    report offsets by partition, else the report of the source itself."""
    progress = query.lastProgress
    return [] if progress is None else [row for s in progress.sources for row in lag_rows(s.description, s.endOffset, s.latestOffset)]


def lag_rows(source: str, end: str | None, latest: str | None) -> list[dict]:
    """Rows between two offset reports ({topic: {partition: offset}}); without both there is none.
    A partition the end report lacks is behind by its whole latest offset."""
    try:
        ended, newest = json.loads(end or "{}"), json.loads(latest or "{}")
    except ValueError:
        return []
    if not (isinstance(newest, dict) and all(isinstance(v, dict) for v in newest.values())):
        return []
    return [{"source": source, "topic": topic, "partition": int(part), "lag": offset - ended.get(topic, {}).get(part, 0)}
            for topic, parts in sorted(newest.items()) for part, offset in sorted(parts.items())]
