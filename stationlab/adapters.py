"""Station tables derived from the general event and order tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def readings_from_events(events: DataFrame) -> DataFrame:
    """Every event as one reading of the station named by its type."""
    return events.selectExpr(
        "event_type AS station",
        "upper(event_type) AS station_name",
        "ts AS `timestamp`",
        "CASE WHEN event_id % 97 = 0 THEN NULL"
        " ELSE CAST((event_id * 7919) % 451 AS DOUBLE) / 10.0D - 5.0D END AS temperature",
        "CASE WHEN event_id % 89 = 0 THEN NULL"
        " ELSE CAST((event_id * 104729) % 81 + 20 AS DOUBLE) END AS humidite",
        "CAST(99000 + (event_id * 15485863) % 4001 AS DOUBLE) AS pression",
        "value / 10.0D AS vitesse_vent",
        "CAST(user_id AS DOUBLE) * 2.4D AS direction_vent",
        "CASE WHEN event_id % 5 = 0 THEN value / 100.0D ELSE 0.0D END AS precipitation",
    )


def alerts_from_orders(orders: DataFrame) -> DataFrame:
    """Every order as one alert; some have no end."""
    return orders.selectExpr(
        "o_orderkey AS id",
        "o_orderstatus AS type_alerte",
        "o_orderpriority AS niveau",
        "concat('zone_', CAST(o_custkey % 10 AS STRING)) AS zone",
        "o_orderdate AS debut",
        "CASE WHEN o_orderkey % 7 = 0 THEN NULL"
        " ELSE o_orderdate + make_dt_interval(CAST(o_orderkey % 30 AS INT)) END AS fin",
        "CAST(substring(o_orderpriority, 1, 1) AS INT) AS severite",
        "o_orderkey % 2 = 0 AS active",
    )


def readings(spark: SparkSession, folder: str) -> DataFrame:
    return readings_from_events(table(spark, folder, "events"))


def alerts(spark: SparkSession, folder: str) -> DataFrame:
    return alerts_from_orders(table(spark, folder, "orders"))


def station_catalogue(events: DataFrame) -> DataFrame:
    """The stations that report, with their display names."""
    return events.select(
        F.col("event_type").alias("station"), F.upper("event_type").alias("station_name")
    ).distinct()


def urban_events(events: DataFrame) -> DataFrame:
    """Every event as an urban event of its station lasting up to an hour."""
    return events.select(
        F.col("event_id").alias("id_evenement"),
        F.col("event_type").alias("station"),
        F.col("ts").alias("debut"),
        (F.col("ts") + F.expr("make_dt_interval(0, 0, CAST(event_id % 60 AS INT), 0)")).alias("fin"),
    )
