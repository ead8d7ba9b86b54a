"""Databases and message brokers; their connectors are supplied by the caller."""

from pyspark.sql import DataFrame, DataFrameWriter
from pyspark.sql import functions as F

from stationlab.functions import nan_to_null, to_json_message
from stationlab.schemas import MEASURES
from stationlab.sources.tables import jdbc_options


def jdbc_writer(df: DataFrame, table: str, url: str, user: str, password: str, **more) -> DataFrameWriter:
    return df.write.format("jdbc").options(**jdbc_options(url, table, user, password, **more))


def write_jdbc(df: DataFrame, table: str, url: str, user: str, password: str, **more) -> None:
    """Append to a database table."""
    jdbc_writer(df, table, url, user, password, **more).mode("append").save()


def to_messages(df: DataFrame) -> DataFrame:
    """Readings as messages: station as key, JSON without missing fields as value."""
    value = to_json_message(
        F.col("station"),
        F.col("timestamp").cast("string").alias("timestamp"),
        *[nan_to_null(m).alias(m) for m in MEASURES],
    )
    return df.select(F.col("station").alias("key"), value.alias("value"))


def write_kafka(df: DataFrame, servers: str, topic: str) -> None:
    """Send a batch of readings; needs the Kafka connector on the class path."""
    options = {"kafka.bootstrap.servers": servers, "topic": topic}
    to_messages(df).write.format("kafka").options(**options).save()
