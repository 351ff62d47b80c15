"""Point-in-time fraud features: each row sees itself and earlier transactions only."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillwork.functions.scalars import as_number, instant, micros, to_cad
from tillwork.operators.ordered import Running, largest_group, scan, sliding_sums
from tillwork.session import hot_rows, small

# Feature order of the model vector, and the values that count as a mismatch (fixed values).
FEATURES = ("amount_cad", "network_risk_score", "is_card_not_present", "avs_mismatch", "cvv_mismatch",
            "three_ds_authenticated", "card_txn_count_5m", "card_amount_sum_1h",
            "seconds_since_last_card_txn", "is_new_ip_country", "merchant_amount_zscore")
WINDOWED = ("card_txn_count_5m", "card_amount_sum_1h", "seconds_since_last_card_txn",
            "is_new_ip_country", "merchant_amount_zscore")
AVS_MISMATCH = ("N", "Z")
CVV_MISMATCH = "N"
MIN_MERCHANT_ROWS = 30
LABEL_DELAY_DAYS = 45

# What the training table takes of the fact.
FACT_COLUMNS = ("transaction_id", "card_token", "merchant_id", "created_at", "transaction_date", "amount", "currency",
                "amount_cad", "entry_mode", "avs_result", "cvv_result", "three_ds_authenticated", "network_risk_score",
                "is_approved", "ip_country", "has_fraud_chargeback")

_AT = "_at"


def card_windows(df: DataFrame, count_seconds: int = 300, sum_seconds: int = 3600,
                 largest: int | None = None) -> DataFrame:
    """Transactions of the card in the last five minutes and its amount in the last hour, in the
    card's own currency, peers at the same time included. Needs `_at` (microseconds)."""
    return sliding_sums(df, ["card_token"], _AT, "transaction_id", {
        "card_txn_count_5m": (F.lit(1).cast("bigint"), count_seconds * 1_000_000),
        "card_amount_sum_1h": (F.col("amount"), sum_seconds * 1_000_000),
    }, largest=largest)


def new_country(df: DataFrame, largest: int | None = None) -> DataFrame:
    """Flag the first transaction of a card in a country, unless it is the card's first country.

    Windows by card do it while cards are small. Only the first row per (card, country) can carry
    the flag, so for busy cards a minimum finds it instead: that combines on the map side.
    """
    largest = largest_group(df, ["card_token"]) if largest is None else largest
    if largest <= hot_rows(df.sparkSession):
        def before(*keys):
            return (Window.partitionBy(*keys).orderBy(_AT, "transaction_id")
                    .rowsBetween(Window.unboundedPreceding, -1))

        return df.withColumn("is_new_ip_country",
                             F.col("ip_country").isNotNull()
                             & (F.count("ip_country").over(before("card_token")) > 0)
                             & (F.count(F.lit(1)).over(before("card_token", "ip_country")) == 0))
    first = (df.where(F.col("ip_country").isNotNull()).groupBy("card_token", "ip_country")
             .agg(F.min(F.struct(_AT, "transaction_id")).alias("first")))
    card_first = first.groupBy("card_token").agg(F.min("first").alias("card_first"))
    flagged = (first.join(card_first, "card_token").where("first > card_first")
               .select(F.col("first.transaction_id").alias("transaction_id"),
                       F.lit(True).alias("is_new_ip_country")))
    return (df.join(flagged, "transaction_id", "left")
            .withColumn("is_new_ip_country", F.coalesce("is_new_ip_country", F.lit(False))))


def card_gap(df: DataFrame, largest: int | None = None) -> DataFrame:
    gap = scan(df, ["card_token"], [_AT, "transaction_id"], [Running("_last", "prev", F.col(_AT))], largest=largest)
    return gap.withColumn("seconds_since_last_card_txn", (F.col(_AT) - F.col("_last")) / 1_000_000.0).drop("_last")


def merchant_zscore(df: DataFrame, largest: int | None = None) -> DataFrame:
    """How unusual the amount is among the merchant's earlier ones; 0 before 30 of them or when
    they are all equal.

    Sums are exact decimals in hundredths, whatever the order of rows or the split of a busy merchant, and
    so are the differences taken of them: n * q - s * s, which is the variance times n * (n - 1), and
    n * amount - s. Only those become doubles, so nearly equal large amounts lose nothing. Squares are
    carried as billions and the rest, so their sum holds any amounts; where n * q has over 38 digits, the
    variance is taken of doubles.

    Where no merchant is hot, the rows are dealt before the values of the sums are made, which are wider than
    the amounts they are made of.
    """
    if largest is not None and largest <= hot_rows(df.sparkSession):
        df = df.repartition("merchant_id")
    whole, billion = "decimal(38,0)", F.lit(10 ** 9).cast("decimal(10,0)")
    cents = (F.col("amount").cast("decimal(18,2)") * 100).cast("decimal(18,0)")
    square = (cents * cents).cast("decimal(36,0)")
    prior = scan(df, ["merchant_id"], [_AT, "transaction_id"], [
        Running("_n", "count", F.col("amount"), current=False), Running("_s", "sum", cents, current=False),
        Running("_q", "sum", F.floor(square / billion).cast("decimal(27,0)"), current=False),
        Running("_rest", "sum", (square % billion).cast("decimal(10,0)"), current=False)], largest=largest)
    n, s = F.col("_n").cast("decimal(19,0)"), F.col("_s").cast(whole)
    q = F.try_add(F.try_multiply(F.col("_q").cast(whole), billion), F.col("_rest").cast(whole))
    exact = F.try_subtract(F.try_multiply(n, q), F.try_multiply(s, s)).cast("double")
    rough = F.col("_n") * (F.col("_q").cast("double") * 1e9 + F.col("_rest").cast("double")) - F.col("_s").cast("double") * F.col("_s").cast("double")
    spread = F.coalesce(exact, rough)
    off = ((n * cents).cast(whole) - s).cast("double") / F.col("_n")
    z = off / F.sqrt(spread / (F.col("_n") * (F.col("_n") - 1)))
    usable = (F.col("_n") >= MIN_MERCHANT_ROWS) & (spread > 0)
    return prior.withColumn("merchant_amount_zscore", F.when(usable, z).otherwise(0.0)).drop("_n", "_s", "_q", "_rest")


def windowed_features(df: DataFrame) -> DataFrame:
    """All five windowed features. Group sizes are checked once per key; the card features share
    one shuffle by card when no card is hot. The merchant's comes first: it adds one value to the rows that
    move for the others, and those add four."""
    timed = df.withColumn(_AT, micros("created_at"))
    cards, merchants = largest_group(timed, ["card_token"]), largest_group(timed, ["merchant_id"])
    scored = merchant_zscore(timed, largest=merchants)
    out = new_country(card_gap(card_windows(scored, largest=cards), largest=cards), largest=cards)
    return out.select(*df.columns, *WINDOWED)


def label_mature(day: str, as_of: date) -> Column:
    """Fraud labels arrive up to 45 days late, so younger ones are incomplete."""
    return F.col(day) <= F.date_sub(F.lit(as_of), LABEL_DELAY_DAYS)


def ml_transaction_features(fct: DataFrame, as_of: date) -> DataFrame:
    """The training table: pass-through columns, windowed features, label and its maturity."""
    kept = fct.select(*FACT_COLUMNS).withColumnRenamed("has_fraud_chargeback", "label")
    return windowed_features(kept).drop("ip_country").withColumn(
        "label_mature", label_mature("transaction_date", as_of))


def training_set(features: DataFrame) -> DataFrame:
    """Approved rows with a mature label. Row order is left to the time split, which finds its
    cut without sorting the table."""
    return features.where(F.col("is_approved") & F.col("label_mature"))


def flatten_event(events: DataFrame) -> DataFrame:
    """Nested event payload to the flat columns the vector is built from."""
    p = F.col("raw_payload")
    return events.select(
        "*", p["avs_result"].alias("avs_result"), p["cvv_result"].alias("cvv_result"),
        p["three_ds"]["authenticated"].alias("three_ds_authenticated"),
        p["network_risk_score"].alias("network_risk_score")).drop("raw_payload")


def feature_vector(df: DataFrame, fx: DataFrame | None = None) -> DataFrame:
    """The eleven model inputs as doubles, missing as NaN. With `fx`, amount_cad is computed from
    amount and currency; otherwise it must be present."""
    if fx is not None:
        df = (df.join(small(fx), "currency", "left")
              .withColumn("amount_cad", to_cad(F.col("amount"), F.col("rate_to_cad"))).drop("rate_to_cad"))
    flag = {
        "is_card_not_present": F.col("entry_mode") == "ecommerce",
        "avs_mismatch": F.col("avs_result").isin(*AVS_MISMATCH),
        "cvv_mismatch": F.col("cvv_result") == CVV_MISMATCH,
    }
    values = {name: F.coalesce(flag[name], F.lit(False)).cast("double") if name in flag
              else as_number(F.col(name)) for name in FEATURES}
    return df.withColumns(values)


def merchant_moments(fct: DataFrame) -> DataFrame:
    """Count, mean and squared deviation per merchant, to seed the streaming state."""
    amount = F.col("amount").cast("double")
    n = F.count(F.lit(1))
    return fct.groupBy("merchant_id").agg(
        n.alias("n"), F.avg(amount).alias("mean"),
        (F.coalesce(F.var_samp(amount), F.lit(0.0)) * (n - 1)).alias("m2"))


def card_state(fct: DataFrame) -> DataFrame:
    """Last time and known countries per card; the countries are distinct, so few."""
    return fct.groupBy("card_token").agg(
        F.max(micros("created_at")).alias("last_micros"),
        F.array_sort(F.collect_set("ip_country")).alias("ip_countries"))


def recent(fct: DataFrame, ts: str = "created_at", span: str = "1 hour") -> DataFrame:
    """Rows within `span` of the newest one."""
    newest = fct.agg(F.max(ts).alias("newest")).first()["newest"]
    return fct.where(F.col(ts) >= instant(newest) - F.expr(f"interval {span}"))
