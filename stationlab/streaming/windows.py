"""Event-time windows, duplicates and stored thresholds on streams."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationlab.operators.anomalies import flag_anomalies
from stationlab.operators.joins import is_small

DEFAULT_DELAY = "1 hour"


def with_event_time(df: DataFrame, delay: str = DEFAULT_DELAY) -> DataFrame:
    """Set the watermark: rows later than ``delay`` are dropped by stateful steps.

    A time without zone is cast first, since a watermark needs an instant.
    """
    return df.withColumn("timestamp", F.col("timestamp").cast("timestamp")).withWatermark(
        "timestamp", delay
    )


def drop_repeats(df: DataFrame) -> DataFrame:
    """First copy of each (station, timestamp) within the watermark delay."""
    return df.dropDuplicatesWithinWatermark(["station", "timestamp"])


def _stats(df: DataFrame, *window: str) -> DataFrame:
    return (
        df.groupBy(F.window("timestamp", *window).alias("_w"), "station")
        .agg(
            F.count("*").alias("nb_mesures"),
            F.avg("temperature").alias("temp_moyenne"),
            F.stddev_samp("temperature").alias("temp_volatilite"),
            F.min("temperature").alias("temp_min"),
            F.max("temperature").alias("temp_max"),
        )
        .select(
            "station",
            F.col("_w.start").alias("debut"),
            F.col("_w.end").alias("fin"),
            "nb_mesures",
            "temp_moyenne",
            "temp_volatilite",
            "temp_min",
            "temp_max",
        )
    )


def tumbling_stats(df: DataFrame, width: str = "1 hour") -> DataFrame:
    """Statistics per station and fixed window; also works on a batch."""
    return _stats(df, width)


def sliding_stats(df: DataFrame, width: str = "7 days", slide: str = "1 day") -> DataFrame:
    """Statistics per station and sliding window; also works on a batch."""
    return _stats(df, width, slide)


def flag_with_stored(df: DataFrame, limits: DataFrame) -> DataFrame:
    """Flags and scores of a stream against one stored row of thresholds."""
    if not is_small(limits, 1):
        raise ValueError("thresholds must be a single row")
    return flag_anomalies(df, limits)
