"""Session defaults and small planning helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only if its checked number of rows times a row's bytes stays below this.
BROADCAST_BYTES = 64 << 20


def session(name: str = "strandline", **conf: str) -> SparkSession:
    """A session with the settings the engine is written for; the cluster's own win."""
    builder = SparkSession.builder.appName(name)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
    }
    for key, value in (defaults | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal a table that came in too few splits over the cores; others stay as they are.

    One small file is one split, and what follows (k-mers) is far more work than the input.
    """
    if df.isStreaming:
        return df
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    # the planner's estimate, which runs no job: tables that fill a split for every core come in that many
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    split = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    return df if size >= cores * split else df.repartition(cores, *keys)


def small(df: DataFrame, rows: int, row_bytes: int = 200) -> DataFrame:
    """`df` marked for broadcast if its checked size allows, else unchanged (shuffled joins)."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df
