"""Aggregations.

All of them are partial aggregates on the map side, so one heavy station costs
one row per task in the shuffle.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stationlab.functions import day_string
from stationlab.operators.filters import AsOf, moment, on_day_before, since
from stationlab.schemas import DAY

STATION = ("station_name", "station")


def _avg(c: str, name: str) -> Column:
    return F.avg(c).alias(name)


def _spread(c: str, mean: str, low: str, high: str) -> list[Column]:
    return [F.avg(c).alias(mean), F.min(c).alias(low), F.max(c).alias(high)]


def daily_summary(df: DataFrame) -> DataFrame:
    """One row per station and day.  Anomaly counts need the flags of ``detect_anomalies``."""

    def flagged(flag: str) -> Column:
        return F.count_if(F.col(flag)) if flag in df.columns else F.lit(0).cast("long")

    return (
        df.groupBy("station", day_string("timestamp").alias("date"))
        .agg(
            F.count("*").alias("nb_mesures"),
            *_spread("temperature", "temp_moyenne", "temp_min", "temp_max"),
            F.stddev_samp("temperature").alias("temp_volatilite"),
            *_spread("humidite", "humidite_moyenne", "humidite_min", "humidite_max"),
            *_spread("pression", "pression_moyenne", "pression_min", "pression_max"),
            F.sum("precipitation").alias("precipitation_totale"),
            _avg("vitesse_vent", "vent_moyen"),
            F.max("vitesse_vent").alias("vent_max"),
            flagged("anomalie_temperature").alias("nb_anomalies_temp"),
            flagged("anomalie_vent").alias("nb_anomalies_vent"),
            flagged("anomalie_pression").alias("nb_anomalies_pression"),
        )
        .orderBy("station", "date")
    )


def anomaly_counts(df: DataFrame) -> DataFrame:
    """Flag counts over all rows."""
    return df.agg(
        F.count_if("anomalie_temperature").alias("nb_anomalies_temp"),
        F.count_if("anomalie_vent").alias("nb_anomalies_vent"),
        F.count_if("anomalie_pression").alias("nb_anomalies_pression"),
    )


def monthly_stats(df: DataFrame, as_of: AsOf, months: int = 12) -> DataFrame:
    return (
        since(df, as_of, months, "months")
        .groupBy("station", F.date_trunc("month", "timestamp").alias("mois"))
        .agg(
            F.count("*").alias("nb_mesures"),
            *_spread("temperature", "temp_moyenne", "temp_min", "temp_max"),
            F.stddev_samp("temperature").alias("temp_volatilite"),
            _avg("humidite", "humidite_moyenne"),
            F.sum("precipitation").alias("precipitation_totale"),
            _avg("vitesse_vent", "vent_moyen"),
            F.max("vitesse_vent").alias("vent_max"),
        )
        .orderBy("station", "mois")
    )


def daily_extremes(
    df: DataFrame, as_of: AsOf, days: int = 30, by_station: bool = True
) -> DataFrame:
    keys = STATION if by_station else ()
    shown = ["station_name"] if by_station else []
    return (
        since(df, as_of, days)
        .groupBy(F.to_date("timestamp").alias("date"), *keys)
        .agg(*_spread("temperature", "temp_moyenne", "temp_min", "temp_max"))
        .orderBy(F.desc("date"), *shown)
        .select("date", *shown, "temp_min", "temp_max", "temp_moyenne")
    )


def daily_overview(df: DataFrame, as_of: AsOf, days: int, by_station: bool = True) -> DataFrame:
    """Mean temperature, strongest wind and rain per day of the last ``days``."""
    keys = STATION if by_station else ()
    shown = ["station_name"] if by_station else []
    return (
        since(df, as_of, days)
        .groupBy(F.to_date("timestamp").alias("date"), *keys)
        .agg(
            _avg("temperature", "temp_moy"),
            F.max("vitesse_vent").alias("vent_max"),
            F.sum("precipitation").alias("pluie_totale"),
        )
        .orderBy("date", *shown)
        .select("date", *shown, "temp_moy", "vent_max", "pluie_totale")
    )


def yesterday_by_station(df: DataFrame, as_of: AsOf) -> DataFrame:
    return (
        on_day_before(df, as_of)
        .groupBy(F.to_date("timestamp").alias("date"), *STATION)
        .agg(
            *_spread("temperature", "temp_moyenne", "temp_min", "temp_max"),
            _avg("humidite", "humidite_moyenne"),
            F.sum("precipitation").alias("pluie_totale"),
        )
        .orderBy("station_name")
        .drop("station")
    )


def compare_stations(
    df: DataFrame,
    as_of: AsOf,
    n: int,
    unit: str,
    means: dict[str, str],
    count_as: str | None = None,
) -> DataFrame:
    """Means per station over a recent period, warmest first.

    ``means`` maps measure to output name; the first one drives the order.
    """
    aggregates = [_avg(measure, name) for measure, name in means.items()]
    if count_as:
        aggregates.append(F.count("*").alias(count_as))
    return (
        since(df, as_of, n, unit)
        .groupBy(*STATION)
        .agg(*aggregates)
        .orderBy(F.desc(next(iter(means.values()))), "station_name")
        .drop("station")
    )


def station_ranking(
    df: DataFrame, as_of: AsOf, measure: str = "temperature", ascending: bool = False
) -> DataFrame:
    first = F.asc("valeur_moyenne") if ascending else F.desc("valeur_moyenne")
    return (
        since(df, as_of, 7)
        .groupBy(*STATION)
        .agg(*_spread(measure, "valeur_moyenne", "valeur_min", "valeur_max"))
        .orderBy(first, "station_name")
        .select("station_name", "valeur_moyenne", "valeur_max", "valeur_min")
    )


def describe_by_station(df: DataFrame, by: str = "station_name") -> DataFrame:
    """Mean, min, max and deviation of temperature, rounded for display."""
    t = "temperature"
    return df.groupBy(by).agg(
        F.round(F.avg(t), 2).alias("mean"),
        F.round(F.min(t), 2).alias("min"),
        F.round(F.max(t), 2).alias("max"),
        F.round(F.stddev_samp(t), 2).alias("std"),
    )


def result_stats(df: DataFrame) -> DataFrame:
    """The tiles under a result: means and amplitude over all its rows."""
    return df.agg(
        *_spread("temperature", "temp_moyenne", "temp_min", "temp_max"),
        (F.max("temperature") - F.min("temperature")).alias("amplitude"),
        _avg("humidite", "humidite_moyenne"),
    )


def display_stats(df: DataFrame) -> DataFrame:
    """:func:`result_stats` rounded the way the tiles show it."""
    return result_stats(df).select(
        F.round("temp_moyenne", 1).alias("temp_moyenne"),
        F.round("amplitude", 1).alias("amplitude"),
        F.round("humidite_moyenne", 0).alias("humidite_moyenne"),
    )


def station_count(df: DataFrame, approximate: bool = False) -> DataFrame:
    count = F.approx_count_distinct if approximate else F.count_distinct
    return df.agg(count("station").alias("nb_stations"))


def daily_sketches(df: DataFrame, what: str = "station", bits: int = 12) -> DataFrame:
    """Per day, a sketch of the distinct values: a few kilobytes, whatever the number of rows.

    Sketches of one day merge, so those of new rows are simply appended to a stored table of them.
    """
    return df.groupBy(F.to_date("timestamp").alias(DAY)).agg(F.hll_sketch_agg(what, bits).alias("esquisse"))


def distinct_count(sketches: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Distinct values of all sketches (or per ``by``); the standard error is about 0.8 / sqrt(2^bits), 1.3 % at 12 bits."""
    merged = F.hll_sketch_estimate(F.hll_union_agg("esquisse"))
    return sketches.groupBy(*by).agg(merged.alias("nb_distincts"))


def completeness(df: DataFrame) -> DataFrame:
    """Per column: rows with a value, and all rows.  One pass over the table."""
    names = df.columns
    counts = df.agg(
        F.count("*").alias("_total"), *[F.count(F.col(c)).alias(f"_n{i}") for i, c in enumerate(names)]
    )
    per_column = F.explode(
        F.array(
            *[
                F.struct(F.lit(c).alias("colonne"), F.col(f"_n{i}").alias("non_nulls"))
                for i, c in enumerate(names)
            ]
        )
    )
    return counts.select(per_column.alias("c"), F.col("_total").alias("total")).select("c.*", "total")


def covered_period(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    return df.agg(F.min(ts).alias("debut"), F.max(ts).alias("fin"))


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("nb_lignes"))


def seasonal_profile(df: DataFrame) -> DataFrame:
    """Mean temperature by station, month and hour of day."""
    return df.groupBy(
        "station",
        F.month("timestamp").alias("mois"),
        F.hour("timestamp").alias("heure"),
    ).agg(_avg("temperature", "temp_moyenne"), F.count("*").alias("nb_mesures"))


def warmest_year(df: DataFrame) -> DataFrame:
    return (
        df.groupBy(F.year("timestamp").alias("annee"))
        .agg(_avg("temperature", "temp_moyenne"))
        .orderBy(F.desc("temp_moyenne"), "annee")
        .limit(1)
    )


def period_over_period(df: DataFrame, as_of: AsOf, days: int) -> DataFrame:
    """Mean of the last ``days`` beside the ``days`` before them, per station.

    One pass: the two periods are conditional aggregates, not a self-join.
    """
    end = moment(df, as_of)
    middle = end - F.expr(f"INTERVAL {int(days)} days")
    recent = (F.col("timestamp") >= middle) & (F.col("timestamp") < end)
    both = since(df, as_of, 2 * days).filter(F.col("timestamp") < end)
    return (
        both.groupBy("station")
        .agg(
            F.avg(F.when(recent, F.col("temperature"))).alias("temp_moyenne"),
            F.avg(F.when(~recent, F.col("temperature"))).alias("temp_moyenne_avant"),
            F.count_if(recent).alias("nb_mesures"),
            F.count_if(~recent).alias("nb_mesures_avant"),
        )
        .withColumn("ecart", F.col("temp_moyenne") - F.col("temp_moyenne_avant"))
    )


def latest_per_station(
    df: DataFrame,
    columns: tuple[str, ...] = (
        "temperature",
        "humidite",
        "pression",
        "vitesse_vent",
        "precipitation",
    ),
) -> DataFrame:
    """The newest reading of every station.

    A max over (timestamp, values), so each task ships one row per station and
    no station is gathered or sorted as a whole.
    """
    newest = F.max(F.struct("timestamp", *columns)).alias("_row")
    return df.groupBy("station").agg(newest).select("station", "_row.*")
