"""Landed files: readings as CSV, API pages, city weather, bulletins, event documents."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stationlab.functions import nan_to_null, parse_timestamp, pressure_to_pa
from stationlab.operators.joins import with_station_name
from stationlab.schemas import (
    ALERT_BULLETIN,
    API_ENVELOPE,
    API_LABELS,
    API_MEASURES,
    CITY_WEATHER,
    EVENT_DOC,
    READINGS,
)

Paths = str | list[str]


def read_readings_csv(spark: SparkSession, path: Paths) -> DataFrame:
    """Readings with a header in the declared order.

    The header is checked against the schema: a file that lacks a column fails
    instead of shifting its values into the wrong columns.
    """
    df = (
        spark.read.option("header", True)
        .option("enforceSchema", False)
        .schema(READINGS)
        .csv(path)
    )
    return without_nan(df)


def without_nan(df: DataFrame) -> DataFrame:
    """Not-a-number measures become null, so that no comparison takes them for large values."""
    doubles = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)]
    return df.withColumns({c: nan_to_null(c) for c in doubles})


def latest_drop(spark: SparkSession, folder: str, pattern: str = "*.csv") -> str | None:
    """Path of the newest file under ``folder`` whose name matches; None when there is none.

    Only file names and times are listed; the files are not opened.
    """
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", True)
        .load(folder)
        .select("modificationTime", "path")
    )
    newest = files.orderBy(F.desc("modificationTime"), F.desc("path")).first()
    return newest["path"] if newest else None


def _measure(source: str) -> Column:
    return nan_to_null(F.col(source).try_cast("double"))


def project_api_records(records: DataFrame, *kept: str) -> DataFrame:
    """Source fields to reading columns; text that is no number becomes null."""
    return records.select(
        parse_timestamp("heure_utc").alias("timestamp"),
        *kept,
        *[_measure(field).alias(name) for field, name in API_MEASURES.items()],
        *[F.col(field).alias(name) for field, name in API_LABELS.items()],
    )


def read_api_envelopes(
    spark: SparkSession,
    path: Paths,
    station: str,
    station_name: str,
    multi_line: bool = True,
) -> DataFrame:
    """Landed pages of one station as readings tagged with its id and name."""
    pages = spark.read.schema(API_ENVELOPE).option("multiLine", multi_line).json(path)
    records = pages.select(F.inline("results")).withColumns(
        {"station": F.lit(station), "station_name": F.lit(station_name)}
    )
    return project_api_records(records, "station", "station_name")


STATION_PAGES = T.StructType([*API_ENVELOPE.fields, T.StructField("station", T.StringType())])


def read_all_stations(
    spark: SparkSession, folder: str, stations: DataFrame, multi_line: bool = True
) -> DataFrame:
    """Landed pages of every station in one read.

    Pages lie in ``folder/station=<id>/``; the id is a partition column, so a filter
    on station skips the other folders.  Names come from the catalogue.
    """
    pages = spark.read.schema(STATION_PAGES).option("multiLine", multi_line).json(folder)
    records = pages.select("station", F.inline("results"))
    return with_station_name(project_api_records(records, "station"), stations)


def project_city_weather(docs: DataFrame, seen_at: Column) -> DataFrame:
    """Current-weather documents as readings; pressure goes from hPa to Pa."""
    return docs.select(
        seen_at.alias("timestamp"),
        F.col("name").alias("station"),
        nan_to_null("main.temp").alias("temperature"),
        nan_to_null("main.humidity").alias("humidite"),
        pressure_to_pa(nan_to_null("main.pressure"), "hPa").alias("pression"),
        nan_to_null("wind.speed").alias("vitesse_vent"),
        nan_to_null("wind.deg").alias("direction_vent"),
        F.lit(None).cast("double").alias("precipitation"),
        F.get("weather", F.lit(0))["description"].alias("description"),
    )


def read_city_weather(spark: SparkSession, path: Paths, multi_line: bool = True) -> DataFrame:
    """Landed current-weather documents; a reading's time is the time of its file."""
    docs = spark.read.schema(CITY_WEATHER).option("multiLine", multi_line).json(path)
    return project_city_weather(docs, F.col("_metadata.file_modification_time"))


def read_alert_bulletins(spark: SparkSession, path: Paths, multi_line: bool = True) -> DataFrame:
    bulletins = spark.read.schema(ALERT_BULLETIN).option("multiLine", multi_line).json(path)
    return bulletins.select(F.inline("results")).withColumnRenamed("message", "description")


def read_event_documents(spark: SparkSession, path: Paths, multi_line: bool = False) -> DataFrame:
    """Event documents of either published shape, with the shared facts lifted to the top."""
    docs = spark.read.schema(EVENT_DOC).option("multiLine", multi_line).json(path)
    meta = F.col("metadonnees")
    return docs.withColumns(
        {
            "timestamp": parse_timestamp("timestamp"),
            "type_evenement": F.coalesce("type_evenement", meta["type_evenement"]),
            "zone_geographique": F.coalesce("zone_geographique", meta["zone_geographique"]),
            "description": F.coalesce("description", "contenu"),
            "entites_extraites": F.coalesce("entites_extraites", meta["entites_extraites"]),
        }
    ).drop("contenu")
