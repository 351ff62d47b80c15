"""What the feature stream does with each micro-batch: merchant scores, model scores, tables.

Everything here is a batch job over the rows of one micro-batch and small tables carried from batch to
batch. Each batch writes folders of its own number, and reads what the batch before it carried, so a batch
that is repeated after a failure replaces its own output and nothing is counted twice.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from tillwork.operators.ordered import Running, scan
from tillwork.session import materialize, small
from tillwork.streaming.feature_stream import lag_rows

MIN_MERCHANT_ROWS = 30
MOMENTS = "merchant_id string, n long, mean double, m2 double"
COLUMNS = ("transaction_id", "card_token", "merchant_id", "event_time", "amount", "currency", "entry_mode", "is_late", "processed_at",
           "card_txn_count_5m", "card_amount_sum_1h", "seconds_since_last_card_txn", "is_new_ip_country", "merchant_amount_zscore",
           "fraud_score", "model_version", "score_error")


def merchant_scores(rows: DataFrame, moments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with merchant_amount_zscore, moments after them): how unusual an amount is among those of its
    merchant that arrived before it, in earlier batches or this one. Late rows have none and do not count.

    `moments` (merchant_id, n, mean, m2) are those before the batch. Within the batch, sums of amounts less
    a reference (the mean so far, or the first amount) run in order of arrival; `scan` splits a merchant
    with very many rows into segments whose sums are merged. The batch's own moments are partial sums per
    task, merged by merchant.
    """
    on_time = rows.where(~F.col("is_late"))
    before = moments.select(F.col("merchant_id").alias("_m"), F.col("n").alias("_n0"), F.col("mean").alias("_mean"), F.col("m2").alias("_m2"))
    first = on_time.groupBy(F.col("merchant_id").alias("_b")).agg(
        F.min_by("amount", F.struct("offset", "part")).alias("_first"), F.count(F.lit(1)).alias("_rows"))
    started = (first.join(before, F.col("_b") == F.col("_m"), "left")
               .select("_b", "_rows", F.coalesce("_n0", F.lit(0)).alias("_n0"), F.coalesce("_mean", "_first").alias("_ref"), F.coalesce("_m2", F.lit(0.0)).alias("_m2")))
    started = materialize(started, "merchants")
    largest = started.agg(F.max("_rows")).first()[0] or 0
    started = small(started.drop("_rows"))
    held = on_time.join(started, F.col("merchant_id") == F.col("_b")).withColumn("_off", F.col("amount") - F.col("_ref"))
    run = scan(held, ["merchant_id"], ["offset", "part"], [
        Running("_k", "count", F.col("_off"), current=False), Running("_s", "sum", F.col("_off"), current=False),
        Running("_q", "sum", F.col("_off") * F.col("_off"), current=False)], largest=largest)
    n, s, square = F.col("_n0") + F.col("_k"), F.coalesce("_s", F.lit(0.0)), F.col("_m2") + F.coalesce("_q", F.lit(0.0))
    spread = square - s * s / F.greatest(n, F.lit(1))
    # Equal amounts leave a rounding residue instead of zero.
    usable = (n >= MIN_MERCHANT_ROWS) & (spread > square * 1e-12)
    z = F.when(usable, (F.col("_off") - s / n) / F.sqrt(spread / (n - 1))).otherwise(0.0)
    scored = run.select(*rows.columns, z.alias("merchant_amount_zscore")).unionByName(
        rows.where("is_late").withColumn("merchant_amount_zscore", F.lit(None).cast("double")))

    sums = held.groupBy("merchant_id", "_n0", "_ref", "_m2").agg(F.count("_off").alias("k"), F.sum("_off").alias("s"), F.sum(F.col("_off") * F.col("_off")).alias("q"))
    count = F.col("_n0") + F.col("k")
    after = sums.select("merchant_id", count.alias("n"), (F.col("_ref") + F.col("s") / count).alias("mean"),
                        F.greatest(F.lit(0.0), F.col("_m2") + F.col("q") - F.col("s") * F.col("s") / count).alias("m2"))
    untouched = moments.join(started.select("_b"), F.col("merchant_id") == F.col("_b"), "left_anti")
    return scored, after.unionByName(untouched.select("merchant_id", "n", "mean", "m2"))


class FeatureSink:
    """foreachBatch function of the feature stream. Under `path`: `features/batch=N` (by processing day),
    `outcomes/batch=N` (processed, late, scored and failed rows) and `moments/batch=N`.

    `merchants` are moments to start with. `score` adds fraud_score and model_version to the rows; if it
    fails, the rows of that batch keep null in both and the reason in score_error, and the stream goes on.
    `also` are functions of (rows, batch number), for other outputs of the same rows.
    """

    def __init__(self, path: str, merchants: DataFrame | None = None, score: Callable[[DataFrame], DataFrame] | None = None,
                 also: Sequence[Callable[[DataFrame, int], None]] = ()):
        self.path, self.score, self.also = path, score, also
        self.merchants = None if merchants is None else materialize(merchants.select("merchant_id", "n", "mean", "m2"), "moments")

    def _moments(self, spark: SparkSession, batch_id: int) -> DataFrame:
        if batch_id > 0:
            try:
                return spark.read.schema(MOMENTS).parquet(f"{self.path}/moments/batch={batch_id - 1:012d}")
            except AnalysisException:       # the sink began with a checkpoint that was already in use
                pass
        return self.merchants if self.merchants is not None else spark.createDataFrame([], MOMENTS)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark, folder = batch.sparkSession, f"batch={batch_id:012d}"
        rows = materialize(batch, "arrivals")       # written once: what follows reads it several times
        scored, moments = merchant_scores(rows, self._moments(spark, batch_id))
        moments.write.mode("overwrite").parquet(f"{self.path}/moments/{folder}")
        made = self._scored(scored).select(*COLUMNS)
        made.withColumn("date", F.to_date("processed_at")).write.mode("overwrite").partitionBy("date").parquet(f"{self.path}/features/{folder}")
        made = features(spark, self.path, [batch_id])
        failed = F.col("score_error").isNotNull()
        made.agg(F.count_if(~F.col("is_late")).alias("processed"), F.count_if("is_late").alias("late"),
                 F.count_if(F.col("fraud_score").isNotNull()).alias("scored"), F.count_if(failed).alias("failed"),
                 F.max("processed_at").alias("at")).write.mode("overwrite").parquet(f"{self.path}/outcomes/{folder}")
        for write in self.also:
            write(made, batch_id)

    def _scored(self, rows: DataFrame) -> DataFrame:
        none = {"fraud_score": F.lit(None).cast("double"), "model_version": F.lit(None).cast("string"), "score_error": F.lit(None).cast("string")}
        if self.score is None:
            return rows.withColumns(none)
        pinned = materialize(rows, "unscored")
        try:
            # Written here, so that an error of the model shows here and not in the sink.
            return materialize(self.score(pinned).withColumn("score_error", none["score_error"]).select(*COLUMNS), "scored")
        except Exception as error:      # whatever a model may raise
            return pinned.withColumns({**none, "score_error": F.lit(f"{type(error).__name__}: {error}"[:500])})


def _batches(spark: SparkSession, path: str, name: str, only: Sequence[int] | None = None) -> DataFrame:
    folders = [f"{path}/{name}/batch=*"] if only is None else [f"{path}/{name}/batch={n:012d}" for n in only]
    return spark.read.option("basePath", f"{path}/{name}").parquet(*folders)


def features(spark: SparkSession, path: str, only: Sequence[int] | None = None) -> DataFrame:
    """The feature rows of all batches, or of some."""
    found = _batches(spark, path, "features", only)
    return found.select(*[c for c in COLUMNS if c in found.columns], "batch")


def outcome_metrics(spark: SparkSession, path: str) -> DataFrame:
    """(at, metric, labels, value) per batch, as the alert rules read them: rows by outcome."""
    kinds = ("processed", "late", "scored", "failed")
    held = _batches(spark, path, "outcomes").where("at is not null")
    each = [held.select("at", F.lit("stream_events_total").alias("metric"), F.create_map(F.lit("outcome"), F.lit(k)).alias("labels"),
                        F.col(k).cast("double").alias("value")) for k in kinds]
    return reduce(DataFrame.unionByName, each)


class LagListener(StreamingQueryListener):
    """Appends how far each source partition was behind after every batch to a table of metrics
    (at, metric, labels, value). A source that reports no offsets by partition adds nothing."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        rows = [(progress.timestamp, "stream_consumer_lag", {"topic": r["topic"], "partition": str(r["partition"])}, float(r["lag"]))
                for s in progress.sources for r in lag_rows(s.description, _text(s.endOffset), _text(s.latestOffset))]
        if rows:
            made = self.spark.createDataFrame(rows, "at string, metric string, labels map<string,string>, value double")
            made.withColumn("at", F.to_timestamp("at")).write.mode("append").parquet(self.path)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def _text(offset) -> str | None:
    return offset if offset is None or isinstance(offset, str) else json.dumps(offset)
