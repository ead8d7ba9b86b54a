"""Starting queries: triggers, output modes and checkpoints."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from stationlab.session import checkpoint_folder

# Seconds between micro-batches, or None to work off what is there and stop.
Trigger = int | None
DEFAULT_INTERVAL = 30


def trigger_options(trigger: Trigger) -> dict[str, object]:
    return {"availableNow": True} if trigger is None else {"processingTime": f"{trigger} seconds"}


def query_checkpoint(spark: SparkSession, name: str) -> str:
    """A query's folder under the shared checkpoint folder."""
    return f"{checkpoint_folder(spark).rstrip('/')}/queries/{name}"


def start(
    df: DataFrame,
    path: str,
    checkpoint: str,
    trigger: Trigger = DEFAULT_INTERVAL,
    mode: str = "append",
    fmt: str = "parquet",
) -> StreamingQuery:
    """Write a stream to files; the checkpoint makes a restart continue where it stopped."""
    writer = df.writeStream.format(fmt).outputMode(mode).option("checkpointLocation", checkpoint)
    return writer.trigger(**trigger_options(trigger)).start(path)


def start_console(
    df: DataFrame, checkpoint: str, trigger: Trigger = DEFAULT_INTERVAL, mode: str = "append"
) -> StreamingQuery:
    """Show a stream on the console, columns in full."""
    writer = (
        df.writeStream.format("console")
        .outputMode(mode)
        .option("truncate", False)
        .option("checkpointLocation", checkpoint)
    )
    return writer.trigger(**trigger_options(trigger)).start()


def start_memory(df: DataFrame, name: str, trigger: Trigger = None, mode: str = "append") -> StreamingQuery:
    """Collect a stream in a driver-side table; for tests and small looks only."""
    writer = df.writeStream.format("memory").queryName(name).outputMode(mode)
    return writer.trigger(**trigger_options(trigger)).start()
