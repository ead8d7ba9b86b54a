"""End-to-end jobs.  Rolling metrics and exact thresholds run counting queries when a job is built."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from stationlab.operators.blocks import BLOCK_ROWS
from stationlab.operators.dedup import union_all
from stationlab.operators.filters import drop_incomplete
from stationlab.operators.metrics import compute_metrics, enrich
from stationlab.operators.summaries import daily_summary
from stationlab.schemas import READINGS
from stationlab.session import own_folder, remove_folder
from stationlab.plans.stored import flagged, store_and_update
from stationlab.sinks.files import write_csv
from stationlab.sources.files import read_all_stations, read_readings_csv
from stationlab.streaming.messages import parse_readings
from stationlab.streaming.rolling import rolling_stream
from stationlab.streaming.run import DEFAULT_INTERVAL, Trigger, start, start_console
from stationlab.streaming.store import store_stream
from stationlab.streaming.windows import (
    DEFAULT_DELAY,
    drop_repeats,
    flag_with_stored,
    with_event_time,
)


def run_batch(
    spark: SparkSession,
    source: str,
    target: str,
    mode: str = "rows",
    pressure_unit: str = "Pa",
    exact: bool = False,
    single_file: bool = False,
    block_rows: int = BLOCK_ROWS,
    staging: str | None = None,
) -> DataFrame:
    """CSV readings to CSV metrics.  Returns the written result, read back.

    The job passes over its input several times (counts, thresholds, metrics), and
    parsing CSV is the dear part of a pass.  So the clean readings are parsed once into columnar files, and the
    passes read only the columns they need: in ``staging``, a folder all executors share that is the
    caller's to remove, or in a folder of the job's own under the shared checkpoint folder, removed at its end.

    Counting or showing the returned frame scans the output, not the job again.
    """
    clean = drop_incomplete(read_readings_csv(spark, source))
    folder = staging or own_folder(spark, "staging")
    clean.write.mode("overwrite").parquet(folder)
    clean = spark.read.schema(clean.schema).parquet(folder)
    computed = compute_metrics(clean, mode, pressure_unit, exact, block_rows)
    write_csv(computed, target, single_file)
    if not staging:
        remove_folder(spark, folder)
    return spark.read.option("header", True).schema(computed.schema).csv(target)


def stream_metrics(
    messages: DataFrame, limits: DataFrame | None = None, delay: str = DEFAULT_DELAY
) -> DataFrame:
    """Messages to metrics: parse, drop repeats, roll, enrich, and flag if thresholds are given."""
    rows = drop_incomplete(parse_readings(messages)).select(*READINGS.names)
    unique = drop_repeats(with_event_time(rows, delay))
    enriched = enrich(rolling_stream(unique, delay=None))
    return enriched if limits is None else flag_with_stored(enriched, limits)


def run_stream(
    messages: DataFrame,
    checkpoint: str,
    target: str | None = None,
    limits: DataFrame | None = None,
    delay: str = DEFAULT_DELAY,
    trigger: Trigger = DEFAULT_INTERVAL,
) -> StreamingQuery:
    """Start the streaming job, to files or (without ``target``) to the console."""
    computed = stream_metrics(messages, limits, delay)
    if target is None:
        return start_console(computed, checkpoint, trigger)
    return start(computed, target, checkpoint, trigger)


def collect_and_process(
    spark: SparkSession,
    pages: str,
    stations: DataFrame,
    table: str,
    results: str,
    extra: list[DataFrame] = (),
    mode: str = "rows",
) -> DataFrame:
    """Landed pages into the stored readings, their metrics brought up to date, daily summary back.

    Known readings are ignored on insert, so running the job again is harmless; metrics are computed again
    only for the days that new readings can change.
    """
    collected = union_all([read_all_stations(spark, pages, stations), *extra])
    store_and_update(drop_incomplete(collected, ("timestamp", "station")), table, results, mode)
    return daily_summary(flagged(spark, results))


def store_messages(
    messages: DataFrame,
    table: str,
    checkpoint: str,
    name: str = "messages",
    delay: str = DEFAULT_DELAY,
    trigger: Trigger = DEFAULT_INTERVAL,
) -> StreamingQuery:
    """Readings from a message stream into a table stored by day, each key once."""
    rows = drop_incomplete(parse_readings(messages)).select(*READINGS.names)
    return store_stream(drop_repeats(with_event_time(rows, delay)), table, checkpoint, name, trigger=trigger)
