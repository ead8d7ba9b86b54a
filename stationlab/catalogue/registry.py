"""Registration and the common table expressions of the SQL side."""

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

AS_OF = "2024-01-31 00:00:00"
ALERTS_AS_OF = "2001-07-15 00:00:00"

_CTES = {
    "readings": """
      SELECT event_type AS station, upper(event_type) AS station_name, ts AS "timestamp",
        CASE WHEN event_id % 97 = 0 THEN NULL
             ELSE CAST((event_id * 7919) % 451 AS DOUBLE) / 10.0 - 5.0 END AS temperature,
        CASE WHEN event_id % 89 = 0 THEN NULL
             ELSE CAST((event_id * 104729) % 81 + 20 AS DOUBLE) END AS humidite,
        CAST(99000 + (event_id * 15485863) % 4001 AS DOUBLE) AS pression,
        value / 10.0 AS vitesse_vent,
        CAST(user_id AS DOUBLE) * 2.4 AS direction_vent,
        CASE WHEN event_id % 5 = 0 THEN value / 100.0 ELSE 0.0 END AS precipitation
      FROM events""",
    "clean": """
      SELECT * FROM readings
      WHERE temperature IS NOT NULL AND "timestamp" IS NOT NULL AND station IS NOT NULL""",
    "alerts": """
      SELECT o_orderkey AS id, o_orderstatus AS type_alerte, o_orderpriority AS niveau,
        'zone_' || CAST(o_custkey % 10 AS VARCHAR) AS zone, o_orderdate AS debut,
        CASE WHEN o_orderkey % 7 = 0 THEN NULL
             ELSE o_orderdate + to_days(CAST(o_orderkey % 30 AS INT)) END AS fin,
        CAST(substring(o_orderpriority, 1, 1) AS INT) AS severite,
        o_orderkey % 2 = 0 AS active
      FROM orders""",
    "enriched": """
      SELECT *,
        CASE WHEN temperature BETWEEN 18 AND 24 AND humidite BETWEEN 40 AND 60 THEN 'optimal'
             WHEN temperature > 30 THEN 'trop_chaud'
             WHEN temperature > 25 AND humidite > 70 THEN 'chaud_humide'
             WHEN temperature < 5 THEN 'tres_froid'
             WHEN temperature < 10 THEN 'froid'
             WHEN humidite > 80 THEN 'tres_humide'
             WHEN humidite < 30 THEN 'sec' ELSE 'modere' END AS indice_confort,
        CASE WHEN humidite > 80 AND pression < 101000 THEN 'eleve'
             WHEN humidite > 70 THEN 'modere'
             WHEN humidite > 60 THEN 'faible' ELSE 'tres_faible' END AS risque_precipitation,
        CASE WHEN temperature < 10 THEN temperature - vitesse_vent * 0.5
             WHEN temperature > 25 THEN temperature + (humidite - 50) * 0.1
             ELSE temperature END AS temperature_ressentie
      FROM clean""",
    "limits": """
      SELECT quantile_disc(temperature, 0.05) AS temp_p5,
        quantile_disc(temperature, 0.95) AS temp_p95,
        quantile_disc(vitesse_vent, 0.95) AS vent_p95,
        quantile_disc(pression, 0.05) AS pression_p5,
        quantile_disc(pression, 0.95) AS pression_p95
      FROM clean""",
    "rolled": """
      SELECT *,
        avg(temperature) OVER (o ROWS BETWEEN 168 PRECEDING AND CURRENT ROW) AS temp_moy_7j,
        avg(temperature) OVER (o ROWS BETWEEN 720 PRECEDING AND CURRENT ROW) AS temp_moy_30j,
        stddev_samp(temperature) OVER (o ROWS BETWEEN 168 PRECEDING AND CURRENT ROW)
          AS temp_volatilite_7j,
        stddev_samp(temperature) OVER (o ROWS BETWEEN 720 PRECEDING AND CURRENT ROW)
          AS temp_volatilite_30j,
        temperature - lag(temperature, 24) OVER o AS temp_tendance_24h
      FROM enriched WINDOW o AS (PARTITION BY station ORDER BY "timestamp")""",
    "flagged": """
      SELECT r.*,
        coalesce(temperature < temp_p5 OR temperature > temp_p95, false) AS anomalie_temperature,
        CASE WHEN temperature < temp_p5 THEN (temp_p5 - temperature) / nullif(temp_p5, 0)
             WHEN temperature > temp_p95 THEN (temperature - temp_p95) / nullif(temp_p95, 0)
             ELSE 0.0 END AS score_anomalie_temp,
        coalesce(vitesse_vent > vent_p95, false) AS anomalie_vent,
        CASE WHEN vitesse_vent > vent_p95 THEN (vitesse_vent - vent_p95) / nullif(vent_p95, 0)
             ELSE 0.0 END AS score_anomalie_vent,
        coalesce(pression < pression_p5 OR pression > pression_p95, false) AS anomalie_pression,
        CASE WHEN pression < pression_p5 THEN (pression_p5 - pression) / nullif(pression_p5, 0)
             WHEN pression > pression_p95 THEN (pression - pression_p95) / nullif(pression_p95, 0)
             ELSE 0.0 END AS score_anomalie_pression
      FROM rolled r CROSS JOIN limits""",
    "hourly": """
      SELECT date_trunc('hour', "timestamp") AS "timestamp", station, "timestamp" AS mesure_le,
        temperature, humidite
      FROM readings""",
}
_NEEDS = {
    "readings": (),
    "clean": ("readings",),
    "alerts": (),
    "enriched": ("readings", "clean"),
    "limits": ("readings", "clean"),
    "rolled": ("readings", "clean", "enriched"),
    "flagged": ("readings", "clean", "enriched", "limits", "rolled"),
    "hourly": ("readings",),
}


def rounded(df: DataFrame) -> DataFrame:
    """Doubles at six decimals off exact ties, times without zone, so results can be compared."""

    def shown(field: T.StructField):
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DoubleType):
            return (F.round(c + F.lit(1e-9), 6) + F.lit(0.0)).alias(field.name)
        if isinstance(field.dataType, T.TimestampType):
            return c.cast("timestamp_ntz").alias(field.name)
        return c

    return df.select([shown(f) for f in df.schema.fields])


def r(expression: str, name: str | None = None) -> str:
    """The SQL twin of :func:`rounded` for one expression."""
    return f"round({expression} + 1e-9, 6) + 0.0 AS {name or expression}"


def sql(body: str, *needs: str) -> str:
    names = dict.fromkeys(n for need in needs for n in (*_NEEDS[need], need))
    ctes = ",\n".join(f"{n} AS ({_CTES[n]})" for n in names)
    return f"WITH {ctes}\n{body}" if ctes else body


def query(name: str, oracle: str | None = None, needs: tuple[str, ...] = ()):
    """Register a Spark query and its SQL twin (over the named table expressions)."""

    def register(build: Query) -> Query:
        @functools.wraps(build)
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return rounded(build(spark, folder))

        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = sql(oracle, *needs)
        return build

    return register
