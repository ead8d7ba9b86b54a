"""From messages to rows: parsing, routing by topic, counting."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stationlab.functions import (
    decode_bytes,
    or_default,
    parse_json_message,
    parse_timestamp,
    payload_preview,
)
from stationlab.schemas import ALERT_MESSAGE, TOPIC_ALERTS, TOPIC_READINGS, WIRE
from stationlab.sources.files import without_nan
from stationlab.streaming.run import Trigger, trigger_options


def parse_readings(messages: DataFrame) -> DataFrame:
    """Message values as readings, with the arrival time beside the event time.

    Text that is no reading gives a row of nulls; ``drop_incomplete`` removes it.
    """
    parsed = messages.select(
        parse_json_message("value", WIRE).alias("data"),
        F.col("timestamp").alias("kafka_timestamp"),
    ).select("data.*", "kafka_timestamp")
    return without_nan(parsed.withColumn("timestamp", parse_timestamp("timestamp")))


def readings_of(messages: DataFrame) -> DataFrame:
    return parse_readings(messages.filter(F.col("topic") == TOPIC_READINGS))


def alerts_of(messages: DataFrame) -> DataFrame:
    """Alert messages; a missing type or level shows as Unknown."""
    data = parse_json_message("value", ALERT_MESSAGE)
    return (
        messages.filter(F.col("topic") == TOPIC_ALERTS)
        .select(data.alias("data"), F.col("timestamp").alias("kafka_timestamp"))
        .select(
            or_default("data.type_alerte").alias("type_alerte"),
            or_default("data.niveau").alias("niveau"),
            "data.zone",
            parse_timestamp("data.debut").alias("debut"),
            parse_timestamp("data.fin").alias("fin"),
            "data.description",
            "kafka_timestamp",
        )
    )


def others_of(messages: DataFrame) -> DataFrame:
    """Messages of any other topic, with the start of their payload for display."""
    known = F.col("topic").isin(TOPIC_READINGS, TOPIC_ALERTS)
    payload = decode_bytes("value")
    return messages.filter(~known).select(
        "topic", payload.alias("value"), payload_preview(payload).alias("apercu"), "timestamp"
    )


ROUTES = {"readings": readings_of, "alerts": alerts_of, "others": others_of}


def start_routes(
    messages: DataFrame, folder: str, checkpoint: str, trigger: Trigger = None
) -> StreamingQuery:
    """Write each kind of message to its own folder, reading the topics once.

    A batch overwrites the folder of its own number, so a batch that is run again
    after a failure leaves the same files.
    """

    def write(batch: DataFrame, number: int) -> None:
        kept = batch.persist()
        try:
            for name, project in ROUTES.items():
                project(kept).write.mode("overwrite").parquet(f"{folder}/{name}/batch={number}")
        finally:
            kept.unpersist()

    writer = messages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(**trigger_options(trigger)).start()


def message_counts(messages: DataFrame) -> DataFrame:
    """Messages so far by topic; write it in update or complete mode."""
    return messages.groupBy("topic").agg(F.count("*").alias("nb_messages"))
