"""Message sources.  Everything downstream needs only ``key, value, topic, timestamp``."""

from pyspark.sql import DataFrame, SparkSession

from stationlab.schemas import API_ENVELOPE, MESSAGES, TOPIC_SETS
from stationlab.sources.files import STATION_PAGES


def topics_of(choice: str) -> tuple[str, ...]:
    if choice not in TOPIC_SETS:
        raise ValueError(f"unknown topic set {choice!r}; one of {sorted(TOPIC_SETS)}")
    return TOPIC_SETS[choice]


def kafka_options(
    servers: list[str] | str,
    topics: tuple[str, ...],
    starting: str = "latest",
    per_trigger: int | None = None,
) -> dict[str, str]:
    """Reader options; ``per_trigger`` bounds the messages of one micro-batch."""
    options = {
        "kafka.bootstrap.servers": servers if isinstance(servers, str) else ",".join(servers),
        "subscribe": ",".join(topics),
        "startingOffsets": starting,
    }
    if per_trigger:
        options["maxOffsetsPerTrigger"] = str(per_trigger)
    return options


def read_topics_stream(
    spark: SparkSession, servers: list[str] | str, choice: str = "meteo", **more
) -> DataFrame:
    """Stream of one of the topic sets.  Needs the Kafka connector on the class path."""
    options = kafka_options(servers, topics_of(choice), **more)
    stream = spark.readStream.format("kafka").options(**options).load()
    return stream.select("key", "value", "topic", "timestamp")


def read_message_files_stream(
    spark: SparkSession, folder: str, files_per_trigger: int | None = None
) -> DataFrame:
    """The same stream from landed JSON lines."""
    reader = spark.readStream.schema(MESSAGES)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.json(folder)


def read_landing_stream(
    spark: SparkSession,
    folder: str,
    by_station: bool = True,
    files_per_trigger: int | None = None,
) -> DataFrame:
    """Landed API pages as they arrive; takes the place of a polling loop."""
    schema = STATION_PAGES if by_station else API_ENVELOPE
    reader = spark.readStream.schema(schema).option("multiLine", True)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.json(folder)
