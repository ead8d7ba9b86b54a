"""The three ready-made views."""

from pyspark.sql import DataFrame

from stationlab.operators.filters import AsOf, active_alerts
from stationlab.operators.ordering import by_severity
from stationlab.operators.summaries import latest_per_station, monthly_stats


def latest_view(readings: DataFrame) -> DataFrame:
    return latest_per_station(readings)


def active_alerts_view(alerts: DataFrame, as_of: AsOf) -> DataFrame:
    shown = [c for c in ("type_alerte", "niveau", "zone", "debut", "fin", "description") if c in alerts.columns]
    return by_severity(active_alerts(alerts, as_of)).select(*shown)


def monthly_view(readings: DataFrame, as_of: AsOf) -> DataFrame:
    return monthly_stats(readings, as_of)


def register_views(readings: DataFrame, alerts: DataFrame, as_of: AsOf) -> None:
    """Make the views callable from SQL in this session."""
    latest_view(readings).createOrReplaceTempView("v_dernieres_mesures")
    active_alerts_view(alerts, as_of).createOrReplaceTempView("v_alertes_actives")
    monthly_view(readings, as_of).createOrReplaceTempView("v_stats_mensuelles")
