"""SQL functions that a session can call by name; Catalyst inlines their bodies."""

from pyspark.sql import SparkSession

# Limits and factors.
_FELT = """
CREATE OR REPLACE TEMPORARY FUNCTION temperature_ressentie(
  temp DOUBLE, humidite DOUBLE, vent DOUBLE)
RETURNS DOUBLE
RETURN CASE
  WHEN temp IS NULL OR humidite IS NULL OR vent IS NULL THEN temp
  WHEN temp < 10 THEN temp - vent * 0.5D
  WHEN temp > 25 THEN temp + (humidite - 50) * 0.1D
  ELSE temp END
"""

_COMFORT = """
CREATE OR REPLACE TEMPORARY FUNCTION classifer_confort(temp DOUBLE, humidite DOUBLE)
RETURNS STRING
RETURN CASE
  WHEN temp IS NULL OR humidite IS NULL THEN 'inconnu'
  WHEN temp BETWEEN 18 AND 24 AND humidite BETWEEN 40 AND 60 THEN 'optimal'
  WHEN temp > 30 OR (temp > 25 AND humidite > 70) THEN 'trop_chaud'
  WHEN temp < 10 THEN 'froid'
  WHEN humidite > 80 THEN 'humide'
  WHEN humidite < 30 THEN 'sec'
  ELSE 'modere' END
"""


def register_sql_functions(spark: SparkSession) -> None:
    """Make ``temperature_ressentie(3)`` and ``classifer_confort(2)`` callable from SQL."""
    spark.sql(_FELT)
    spark.sql(_COMFORT)
