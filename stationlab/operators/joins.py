"""Joins: station dimension, correlation per period, baselines."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stationlab.session import checkpoint_folder

MAX_BROADCAST_ROWS = 1_000_000


def is_small(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> bool:
    """Whether a table has at most ``max_rows`` rows.  Runs a bounded count at once."""
    return df.limit(max_rows + 1).count() <= max_rows


def join_checked(
    big: DataFrame, other: DataFrame, on: list[str], how: str, max_rows: int = MAX_BROADCAST_ROWS
) -> DataFrame:
    """Join that broadcasts ``other`` only after counting it, once; else an ordinary join."""
    small = other.__dict__.setdefault("_counted_small", {})
    if max_rows not in small:
        small[max_rows] = is_small(other, max_rows)
    return big.join(F.broadcast(other) if small[max_rows] else other, on, how)


def join_checked_on(big: DataFrame, other: DataFrame, on: Column, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Inner join on a condition that broadcasts ``other`` only after counting it."""
    return big.join(F.broadcast(other) if is_small(other, max_rows) else other, on)


def with_station_name(df: DataFrame, stations: DataFrame) -> DataFrame:
    """Look up the display name of each reading's station; unknown stations keep null."""
    return join_checked(
        df.drop("station_name"), stations.select("station", "station_name"), ["station"], "left"
    )


def weather_activity_correlation(
    readings: DataFrame,
    activity: DataFrame,
    measure: str = "temperature",
    zone: str = "station",
    period: str = "hour",
) -> DataFrame:
    """Correlation of the mean measure with the number of activities, per zone.

    Both sides shrink to one row per (zone, period) before they meet.  The
    significance is t = r * sqrt((n - 2) / (1 - r^2)), null when it is undefined.
    """
    weather = readings.groupBy(zone, F.date_trunc(period, "timestamp").alias("_at")).agg(
        F.avg(measure).alias("_weather")
    )
    urban = activity.groupBy(zone, F.date_trunc(period, "timestamp").alias("_at")).agg(
        F.count("*").cast("double").alias("_activity")
    )
    r, n = F.col("valeur_correlation"), F.col("nb_periodes")
    return (
        weather.join(urban, [zone, "_at"])
        .filter(F.col("_weather").isNotNull())
        .groupBy(F.col(zone).alias("zone"))
        .agg(F.corr("_weather", "_activity").alias("valeur_correlation"), F.count("*").alias("nb_periodes"))
        .select(
            "zone",
            F.lit(measure).alias("variable_meteo"),
            F.lit("activite").alias("variable_urbaine"),
            F.lit(period).alias("periode_analyse"),
            "valeur_correlation",
            "nb_periodes",
            F.when(
                (n > 2) & (F.abs(r) < 1), r * F.sqrt((n - 2) / (1 - r * r))
            ).alias("significativite"),
        )
    )


def baseline_prediction(df: DataFrame, measure: str = "temperature") -> DataFrame:
    """Each reading beside the mean of its station at the same hour of day.

    The baseline (24 rows a station) is computed at once and counted, so that the
    readings need not move when it is small.
    """
    checkpoint_folder(df.sparkSession)
    hour = F.hour("timestamp")
    baseline = (
        df.groupBy("station", hour.alias("heure"))
        .agg(F.avg(measure).alias("prediction"))
        .checkpoint()
    )
    return join_checked(df.withColumn("heure", hour), baseline, ["station", "heure"], "inner")
