"""The named queries behind the questions, and the step from a question to its rows.

Each query is a function of the tables and a fixed time ``as_of``; nothing reads
the clock.
"""

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationlab.functions import classify_question, first_number, route_of
from stationlab.functions.routing import number_of, ranking_of
from stationlab.operators import summaries
from stationlab.operators.filters import (
    AsOf,
    above,
    at_latest_time,
    of_station,
    since,
    unexpired_alerts,
)
from stationlab.operators.ordering import newest, strongest_first

# Station identifiers the two single-station questions name (fixed values).
STATION_COMPANS = "toulouse_compans_cafarelli"
STATION_METEOPOLE = "toulouse_meteopole"


@dataclass(frozen=True)
class Tables:
    """What a question may read.  ``metrics`` and ``alerts`` are needed by two routes only."""

    readings: DataFrame
    metrics: DataFrame | None = None
    alerts: DataFrame | None = None
    station_compans: str = STATION_COMPANS
    station_meteopole: str = STATION_METEOPOLE


def current(readings: DataFrame) -> DataFrame:
    """All stations at the newest time of the table."""
    return (
        at_latest_time(readings)
        .orderBy("station_name")
        .select("station_name", "temperature", "humidite", "vitesse_vent", "timestamp")
    )


def current_single(readings: DataFrame) -> DataFrame:
    """The newest reading alone."""
    return newest(readings, 1).select(
        "timestamp", "temperature", "humidite", "vitesse_vent", "precipitation"
    )


def one_station(readings: DataFrame, station: str, n: int = 24) -> DataFrame:
    return newest(of_station(readings, station), n).select(
        "timestamp", "temperature", "humidite", "vitesse_vent"
    )


def station_comparison(readings: DataFrame, as_of: AsOf) -> DataFrame:
    means = {
        "temperature": "temp_moyenne",
        "humidite": "humidite_moyenne",
        "vitesse_vent": "vent_moyen",
    }
    return summaries.compare_stations(readings, as_of, 24, "hours", means, count_as="nb_mesures")


def comparison(readings: DataFrame, as_of: AsOf) -> DataFrame:
    means = {
        "temperature": "temp_moyenne",
        "humidite": "humidite_moyenne",
        "vitesse_vent": "vent_moyen",
    }
    return summaries.compare_stations(readings, as_of, 7, "days", means)


def quick_compare(readings: DataFrame, as_of: AsOf) -> DataFrame:
    means = {"temperature": "temp_moy", "humidite": "hum_moy"}
    return summaries.compare_stations(readings, as_of, 24, "hours", means, count_as="nb_mesures")


def temperature_period(readings: DataFrame, as_of: AsOf, days: int = 7) -> DataFrame:
    return newest(since(readings, as_of, days), 100).select(
        "timestamp", "station_name", "temperature", "humidite"
    )


def precipitation(readings: DataFrame, as_of: AsOf) -> DataFrame:
    return (
        since(above(readings, "precipitation", 0), as_of, 7)
        .orderBy(F.desc("timestamp"))
        .select("timestamp", "station_name", "precipitation", "humidite", "temperature")
    )


def strong_wind(readings: DataFrame, as_of: AsOf, limit: float = 15) -> DataFrame:
    windy = since(above(readings, "vitesse_vent", limit), as_of, 7)
    return strongest_first(windy, "vitesse_vent").select(
        "timestamp", "station_name", "vitesse_vent", "direction_vent", "temperature"
    )


def wind_direction(readings: DataFrame, as_of: AsOf) -> DataFrame:
    return (
        since(readings, as_of, 24, "hours")
        .orderBy(F.desc("timestamp"))
        .select("timestamp", "direction_vent", "vitesse_vent")
    )


def trends(metrics: DataFrame, as_of: AsOf) -> DataFrame:
    return (
        since(metrics, as_of, 30)
        .orderBy(F.desc("timestamp"))
        .select("timestamp", "temp_moy_7j", "temp_volatilite_7j", "indice_confort")
    )


def alerts(alert_table: DataFrame, as_of: AsOf) -> DataFrame:
    return (
        unexpired_alerts(alert_table, as_of)
        .orderBy(F.desc("debut"))
        .select("type_alerte", "niveau", "debut", "fin", "zone")
    )


def rain_outlook(readings: DataFrame, as_of: AsOf) -> DataFrame:
    return (
        since(readings, as_of, 24, "hours")
        .orderBy(F.desc("timestamp"))
        .select("timestamp", "station_name", "precipitation", "humidite", "temperature")
    )


def general(readings: DataFrame, n: int = 50) -> DataFrame:
    return newest(readings, n).select(
        "timestamp", "station_name", "temperature", "humidite", "vitesse_vent", "precipitation"
    )


def dashboard_current(readings: DataFrame) -> DataFrame:
    return (
        at_latest_time(readings)
        .orderBy("station_name")
        .select(
            "station_name", "temperature", "humidite", "vitesse_vent", "precipitation", "timestamp"
        )
    )


Handler = Callable[[Tables, AsOf, str], DataFrame]

HANDLERS: dict[str, Handler] = {
    "temperature_period": lambda t, at, q: temperature_period(t.readings, at, number_of(q)),
    "current": lambda t, at, q: current(t.readings),
    "extremes": lambda t, at, q: summaries.daily_extremes(t.readings, at),
    "station_compans": lambda t, at, q: one_station(t.readings, t.station_compans),
    "station_meteopole": lambda t, at, q: one_station(t.readings, t.station_meteopole),
    "precipitation": lambda t, at, q: precipitation(t.readings, at),
    "rain_forecast": lambda t, at, q: rain_outlook(t.readings, at),
    "strong_wind": lambda t, at, q: strong_wind(t.readings, at),
    "wind_direction": lambda t, at, q: wind_direction(t.readings, at),
    "station_comparison": lambda t, at, q: station_comparison(t.readings, at),
    "station_ranking": lambda t, at, q: summaries.station_ranking(t.readings, at, *ranking_of(q)),
    "trends": lambda t, at, q: trends(_needed(t.metrics, "metrics"), at),
    "comparison": lambda t, at, q: comparison(t.readings, at),
    "alerts": lambda t, at, q: alerts(_needed(t.alerts, "alerts"), at),
    "this_week": lambda t, at, q: summaries.daily_overview(t.readings, at, 7),
    "this_month": lambda t, at, q: summaries.daily_overview(t.readings, at, 30),
    "yesterday": lambda t, at, q: summaries.yesterday_by_station(t.readings, at),
    "general": lambda t, at, q: general(t.readings),
}


def _needed(df: DataFrame | None, name: str) -> DataFrame:
    if df is None:
        raise ValueError(f"this question needs the {name} table")
    return df


def answer(question: str, tables: Tables, as_of: AsOf) -> DataFrame:
    """Rows that answer one question; the plan is built, not run."""
    return HANDLERS[route_of(question)](tables, as_of, question)


def answer_stats(result: DataFrame) -> DataFrame | None:
    """The figures shown under an answer: per station when it names stations, else overall."""
    if "temperature" not in result.columns:
        return None
    if "station_name" in result.columns:
        return summaries.describe_by_station(result)
    return summaries.result_stats(result) if "humidite" in result.columns else None


def label_questions(questions: DataFrame, text: str = "text") -> DataFrame:
    """Route and wanted number of days of a whole table of questions."""
    return questions.withColumns({"route": classify_question(text), "jours": first_number(text)})
