"""Training, evaluating and applying the fraud model."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwork.functions.scalars import to_cad
from tillwork.operators.ordered import Running, nth_row, scan
from tillwork.plans.features import FEATURES, WINDOWED, feature_vector, flatten_event, training_set
from tillwork.session import materialize, small

SEED = 42
TOP_SHARE = 0.01
DEFAULT_THRESHOLD = 0.5
MISSING = -1.0
# Inputs that can be missing. Spark's trees do not treat NaN as missing, so these carry a flag.
_GAPS = ("network_risk_score", "three_ds_authenticated", "seconds_since_last_card_txn")
INPUTS = (*FEATURES, *[f"{g}_missing" for g in _GAPS])


def time_split(df: DataFrame, share: float = 0.75, ts: str = "created_at", tie: str = "transaction_id"):
    """(train, valid): the first `share` of the rows in time order, and the rest. The cut is found
    as an order statistic and both parts are filters, so the rows are not sorted."""
    cut = int(df.count() * share)
    if cut == 0:
        return df.where(F.lit(False)), df
    at, last = nth_row(df.select(F.col(ts).cast("timestamp").alias("at"), tie).withColumn(
        "at", F.unix_micros("at")), ["at", tie], cut)
    moment = F.unix_micros(F.col(ts).cast("timestamp"))
    before = (moment < at) | ((moment == at) & (F.col(tie) <= F.lit(last)))
    return df.where(before), df.where(~before)


def model_inputs(df: DataFrame) -> DataFrame:
    """Vector columns with missing values replaced and flagged. Rows that cannot be scored at all,
    having no CAD amount, get usable = false."""
    vector = feature_vector(df)
    flags = {f"{g}_missing": F.isnan(g).cast("double") for g in _GAPS}
    filled = {f: F.when(F.isnan(f), MISSING).otherwise(F.col(f)) for f in FEATURES}
    return vector.withColumn("usable", ~F.isnan("amount_cad")).withColumns(flags).withColumns(filled)


def train(df: DataFrame, iterations: int = 30, depth: int = 4, label: str = "label") -> PipelineModel:
    """Gradient-boosted trees with the positive class weighted up to the size of the negative."""
    rows = model_inputs(df).select(*INPUTS, F.col(label).cast("double").alias("label"))
    counts = rows.agg(F.sum("label").alias("pos"), F.count(F.lit(1)).alias("n")).first()
    weight = (counts["n"] - counts["pos"]) / max(1.0, counts["pos"])
    weighted = rows.withColumn("weight", F.when(F.col("label") == 1, weight).otherwise(1.0))
    return Pipeline(stages=[
        VectorAssembler(inputCols=list(INPUTS), outputCol="inputs", handleInvalid="keep"),
        GBTClassifier(featuresCol="inputs", labelCol="label", weightCol="weight", maxIter=iterations, maxDepth=depth,
                      stepSize=0.1, subsamplingRate=0.8, seed=SEED),
    ]).fit(weighted)


def importances(model: PipelineModel) -> DataFrame:
    from pyspark.sql import SparkSession

    gains = model.stages[-1].featureImportances.toArray()
    return SparkSession.active().createDataFrame(
        [(n, float(g)) for n, g in zip(INPUTS, gains, strict=True)], "feature string, importance double")


def with_probability(df: DataFrame, model: PipelineModel) -> DataFrame:
    """Add `probability_fraud`, keeping the columns of `df`; rows that cannot be scored get null.
    The vector columns replace same-named inputs, so those are carried past the model."""
    kept = df.select("*", F.struct(*df.columns).alias("_row"))
    scored = model.transform(model_inputs(kept))
    return scored.select("_row.*", F.when(F.col("usable"), vector_to_array("probability")[1]).alias("probability_fraud"))


def decide(probability: Column, threshold: float) -> Column:
    return F.when(probability >= threshold, "review").when(probability.isNotNull(), "approve").otherwise("error")


def score(df: DataFrame, model: PipelineModel, threshold: float = DEFAULT_THRESHOLD, version: str = "1") -> DataFrame:
    """Add fraud_score (four digits), decision and model_version."""
    p = F.col("probability_fraud")
    return (with_probability(df, model).withColumns({
        "fraud_score": F.round(p, 4), "decision": decide(p, threshold), "model_version": F.lit(version)})
        .drop("probability_fraud"))


def score_stream(model: PipelineModel, fx: DataFrame, threshold: float = DEFAULT_THRESHOLD,
                 version: str = "1") -> Callable[[DataFrame], DataFrame]:
    """Scoring step for the feature stream. An event that cannot be scored goes on without a score."""
    rates = small(fx)

    def step(rows: DataFrame) -> DataFrame:
        flat = flatten_event(rows) if "raw_payload" in rows.columns else rows
        priced = (flat.join(rates, "currency", "left")
                  .withColumn("amount_cad", to_cad(F.col("amount").cast("decimal(18,2)"), F.col("rate_to_cad"))))
        scored = score(priced, model, threshold, version)
        ok = F.col("fraud_score").isNotNull() & ~F.col("is_late")
        return scored.withColumns({"fraud_score": F.when(ok, F.col("fraud_score")),
                                   "model_version": F.when(ok, F.col("model_version"))})
    return step


def attach_features(events: DataFrame, online: DataFrame) -> DataFrame:
    """Windowed features for events: those sent with the event, else the card's latest stored ones,
    else none. `feature_source` says which; a stored gap of -1 means no previous transaction."""
    stored = online.select("card_token", *[F.col(f).alias(f"_s_{f}") for f in WINDOWED], F.lit(True).alias("_known"))
    joined = events.join(stored, "card_token", "left")
    given = F.col("features").isNotNull()
    out = {}
    for f in WINDOWED:
        kept = F.col(f"_s_{f}")
        if f == "seconds_since_last_card_txn":
            kept = F.when(kept != -1, kept)
        out[f] = F.when(given, F.col("features")[f]).otherwise(kept)
    source = F.when(given, "request").when(F.col("_known"), "online").otherwise("none")
    return joined.select(*events.columns, *[v.alias(n) for n, v in out.items()], source.alias("feature_source")).drop("features")


def evaluate(scored: DataFrame, score: str = "score", label: str = "label", tie: str = "transaction_id",
             top_share: float = TOP_SHARE) -> DataFrame:
    """Ranking quality as one row: average precision (step), ROC area, and the cutoff, precision
    and recall of the riskiest share of rows. Rows are merged per score first, so tied scores are
    one point of the curve and the ordered part runs over distinct scores."""
    rows = scored.select(F.col(score).alias("s"), F.col(label).cast("bigint").alias("y"), F.col(tie).alias("tie"))
    points = materialize(rows.groupBy((-F.col("s")).alias("rank")).agg(
        F.sum("y").alias("pos"), F.count(F.lit(1)).alias("n")), "points")
    totals = points.agg(F.sum("pos").alias("p"), F.sum("n").alias("n")).first()
    positives, count = totals["p"] or 0, totals["n"] or 0
    curve = scan(points, [], ["rank"], [Running("tp", "sum", F.col("pos")), Running("seen", "sum", F.col("n"))])
    hits = float(max(1, positives))
    area = F.sum((F.col("n") - F.col("pos")) * (F.col("tp") - F.col("pos") / 2))
    ranking = curve.agg(F.sum(F.col("pos") / hits * F.col("tp") / F.col("seen")).alias("pr_auc"),
                        (area / float(max(1, positives * (count - positives)))).alias("roc_auc"))
    top = max(1, int(count * top_share))
    cutoff, last = nth_row(rows.select((-F.col("s")).alias("rank"), "tie"), ["rank", "tie"], top)
    flagged = rows.where((-F.col("s") < cutoff) | ((-F.col("s") == cutoff) & (F.col("tie") <= F.lit(last))))
    areas = ranking.first()
    return flagged.agg(F.lit(areas["pr_auc"]).alias("pr_auc"), F.lit(areas["roc_auc"]).alias("roc_auc"),
                       F.lit(-cutoff).alias("threshold_at_1pct"), F.avg("y").alias("precision_at_1pct"),
                       (F.sum("y") / hits).alias("recall_at_1pct"))


def compare_models(challenger: DataFrame, champion: DataFrame | None, **names) -> DataFrame:
    """Average precision of both on the same rows, and whether the challenger takes over. Without
    a champion any challenger does."""
    old = -1.0 if champion is None else evaluate(champion, **names).first()["pr_auc"]
    return evaluate(challenger, **names).select(
        F.col("pr_auc").alias("challenger_pr_auc"), F.lit(old).alias("champion_pr_auc"),
        (F.col("pr_auc") > old).alias("promote"))


def should_train(features: DataFrame, last_rows: int | None) -> bool:
    """Whether the mature training set differs in size from the last run's."""
    return training_set(features).count() != last_rows


@dataclass
class TrainingRun:
    model: PipelineModel
    metrics: dict
    promoted: bool
    rows: int


def train_and_compare(features: DataFrame, champion: PipelineModel | None = None, last_rows: int | None = None,
                      iterations: int = 30) -> TrainingRun | None:
    """Train on the older three quarters, evaluate both models on the rest, decide. None when the
    training set has not changed."""
    rows = training_set(features)
    n = rows.count()
    if n == last_rows:
        return None
    older, newer = time_split(rows)
    model = train(older, iterations)

    def scored(m):
        return with_probability(newer, m).select("transaction_id", "label", F.col("probability_fraud").alias("score"))

    mine = scored(model)
    metrics = evaluate(mine).first().asDict()
    decision = compare_models(mine, None if champion is None else scored(champion)).first()
    return TrainingRun(model, metrics, decision["promote"], n)
