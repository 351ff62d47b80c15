"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Largest group (rows) that one task may sort for an ordered computation. Above it the ordered
# operators cut the group into range segments instead (operators/ordered.py).
HOT_ROWS_CONF = "spark.tillwork.hotGroupRows"
HOT_ROWS_DEFAULT = 200_000

_RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Shuffle files go when their job has ended, not when the driver happens to collect garbage.
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def build_session(app: str = "tillwork", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**_RUNTIME_CONF, **conf}.items():
        builder = builder.config(key, value)
    return prepare(builder.getOrCreate())


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the settings every job here relies on to a session built elsewhere."""
    for key, value in _RUNTIME_CONF.items():
        spark.conf.set(key, value)
    # A cluster sets its own number of shuffle partitions; the default of 200 only hurts locally.
    if spark.sparkContext.master.startswith("local") and spark.conf.get("spark.sql.shuffle.partitions") == "200":
        spark.conf.set("spark.sql.shuffle.partitions", str(spark.sparkContext.defaultParallelism))
    return spark


def small(df: DataFrame, rows: int = 10_000) -> DataFrame:
    """Mark a lookup table for broadcast if it has at most `rows` rows; a larger one is left to a
    shuffle join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def hot_rows(spark: SparkSession) -> int:
    return int(spark.conf.get(HOT_ROWS_CONF, str(HOT_ROWS_DEFAULT)))


_local_root: dict[str, str] = {}


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the cluster's shared checkpoint folder. A temporary folder stands in
    only where that is unset and the session is local."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        app = spark.sparkContext.applicationId
        if app not in _local_root:
            _local_root[app] = tempfile.mkdtemp(prefix="spark-")
        root = _local_root[app]
    return f"{root.rstrip('/')}/tillwork/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str, compression: str | None = None) -> DataFrame:
    """Write `df` to the shared scratch folder and read it back: pins its rows and cuts lineage
    in a way that survives executor loss."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)
