"""Streams into stored tables, each row once."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stationlab.schemas import KEYS
from stationlab.sinks.files import store_new, stored
from stationlab.streaming.run import DEFAULT_INTERVAL, Trigger, trigger_options


def batches_of(path: str) -> str:
    """Where the finished batches of a stored table are noted, beside it."""
    return f"{path.rstrip('/')}-batches"


def store_batch(
    batch: DataFrame, number: int, path: str, name: str, keys: tuple[str, ...] = KEYS, order: tuple[str, ...] = ()
) -> bool:
    """Insert a micro-batch unless it is noted as finished; say whether it was inserted.

    The note follows the rows.  A batch that was cut off between the two is inserted again when it is replayed, and
    finds its rows known.
    """
    spark = batch.sparkSession
    notes = stored(spark, batches_of(path))
    if notes is not None and not notes.filter((F.col("query") == name) & (F.col("batch") == number)).isEmpty():
        return False
    store_new(batch, path, keys, order)
    note = spark.createDataFrame([(name, number)], "query string, batch long")
    note.coalesce(1).write.mode("append").parquet(batches_of(path))
    return True


def store_stream(
    rows: DataFrame,
    path: str,
    checkpoint: str,
    name: str = "stream",
    keys: tuple[str, ...] = KEYS,
    order: tuple[str, ...] = (),
    trigger: Trigger = DEFAULT_INTERVAL,
) -> StreamingQuery:
    """Insert-or-ignore every micro-batch of a stream into a table stored by day.

    ``name`` tells the streams of one table apart in its notes; a stream that starts anew with an empty
    checkpoint counts its batches from zero, so give it another name.
    """
    writer = rows.writeStream.option("checkpointLocation", checkpoint)
    writer = writer.foreachBatch(lambda batch, number: store_batch(batch, number, path, name, keys, order) and None)
    return writer.trigger(**trigger_options(trigger)).start()
