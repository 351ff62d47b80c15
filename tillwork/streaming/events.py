"""Event sources: reading, decoding and publishing card events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillwork.functions.scalars import parse_time
from tillwork.schemas import PAYLOAD

# Fields every event must carry (fixed values).
REQUIRED = ("transaction_id", "card_token", "merchant_id", "amount", "currency", "entry_mode", "created_at")
EVENT = T.StructType([T.StructField(n, T.StringType()) for n in (*REQUIRED, "ip_country")]
                     + [T.StructField("raw_payload", PAYLOAD)])


def event_stream(spark: SparkSession, fmt: str, options: dict[str, str], schema: T.StructType | None = None) -> DataFrame:
    """Raw events. For Kafka give the servers, topic and a maxOffsetsPerTrigger; a new checkpoint
    starts from the earliest offset, an old one continues. File formats take maxFilesPerTrigger.
    The trigger limit is what bounds the rows of one key in one task."""
    defaults = {"startingOffsets": "earliest"} if fmt == "kafka" else {}
    reader = spark.readStream.format(fmt).options(**{**defaults, **options})
    raw = (reader.schema(schema) if schema is not None else reader).load()
    if fmt == "kafka":
        raw = raw.select(F.col("value").cast("string").alias("value"), F.col("partition").alias("part"), "offset")
    return raw


def decode(raw: DataFrame) -> DataFrame:
    """Decode (value, part, offset) rows. `valid` marks JSON objects with all required fields, a
    readable time and a numeric amount."""
    # As a generated row the event is parsed once; a plain column is parsed again for every use of a field.
    parsed = raw.withColumn("_e", F.explode(F.array(F.from_json("value", EVENT))))
    event_time = F.when(F.col("_e.created_at").rlike(r"^\d{4}-?\d{2}"), parse_time(F.col("_e.created_at")))
    present = F.lit(True)
    for name in REQUIRED:
        present = present & (F.coalesce(F.col(f"_e.{name}"), F.lit("")) != "")
    amount = F.col("_e.amount").try_cast("double")
    return parsed.select(
        "value", "part", "offset", *[F.col(f"_e.{n}").alias(n) for n in REQUIRED if n not in ("amount", "created_at")],
        F.col("_e.ip_country").alias("ip_country"), F.col("_e.raw_payload").alias("raw_payload"),
        amount.alias("amount"), event_time.alias("event_time"),
        (present & amount.isNotNull() & event_time.isNotNull()).alias("valid"))


def parse_events(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid events, invalid rows). The invalid ones are for a dead-letter output."""
    decoded = decode(raw)
    return (decoded.where("valid").drop("value", "valid"),
            decoded.where("not valid").select("value", "part", "offset"))


def to_events(df: DataFrame, key: str, private: tuple[str, ...] = ("customer_email",)) -> DataFrame:
    """Rows as JSON events keyed for the bus, without the private columns."""
    public = [c for c in df.columns if c not in private]
    return df.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct(*public)).alias("value"))
