"""Files and stored tables."""

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from stationlab.operators.dedup import DuplicateKeys, clashes, new_rows, repeated_keys
from stationlab.operators.filters import is_dated
from stationlab.schemas import DAY, KEYS

MAX_DAYS = 400
"""A batch of more days reads the target by range of days."""


def write_csv(df: DataFrame, path: str, single_file: bool = False) -> None:
    """Overwrite a folder of CSV files with headers; times keep their microseconds.

    ``single_file`` sends all rows through one task; leave it off for anything large.
    """
    written = (df.coalesce(1) if single_file else df).write.mode("overwrite").option("header", True)
    micros = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
    written.options(timestampFormat=f"{micros}XXX", timestampNTZFormat=micros).csv(path)


def land_raw(df: DataFrame, folder: str, prefix: str, stamp: datetime, fmt: str = "parquet") -> str:
    """Write a raw drop under a folder named by prefix and time, split by station."""
    path = f"{folder}/{prefix}_{stamp:%Y%m%d_%H%M%S}"
    df.write.partitionBy("station").format(fmt).mode("overwrite").save(path)
    return path


def with_created_at(df: DataFrame) -> DataFrame:
    return df.withColumn("created_at", F.current_timestamp())


def dated(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    """The rows with the day of their time; without a time the day is null, a partition of its own."""
    return df.withColumn(DAY, F.to_date(ts))


def append_by_day(df: DataFrame, path: str, mode: str = "append", **options: str) -> None:
    """Write into one folder per day, sorted inside by station and time.

    Rows are dealt out by ranges of (day, station, time): a task writes few days, and a crowded day goes to several.
    Files thus hold narrow ranges of stations, which their statistics let a reader skip.
    """
    order = [c for c in (DAY, "station", "timestamp") if c in df.columns]
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed.write.options(**options).partitionBy(DAY).mode(mode).parquet(path)


def _append(df: DataFrame, path: str) -> None:
    if "timestamp" in df.columns:
        append_by_day(dated(df), path)
    else:
        df.write.mode("append").parquet(path)


def write_readings(df: DataFrame, path: str) -> None:
    """Append readings stamped with their time of writing, in folders by day."""
    _append(with_created_at(df), path)


def stored(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at ``path``, or None when nothing was written there yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() in {"PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"}:
            return None
        raise


def on_days_of(target: DataFrame, batch: DataFrame) -> DataFrame:
    """The part of a table stored by day that can share a time with ``batch``.

    The batch's days are named in the filter, so no other partition is listed or read.  There are at most as
    many as the calendar has; beyond ``MAX_DAYS`` the range from the first to the last is read.
    """
    if not is_dated(target) or "timestamp" not in batch.columns:
        return target
    days = batch.select(F.to_date("timestamp").alias(DAY)).distinct()
    some = [row[0] for row in days.limit(MAX_DAYS + 1).collect()]
    if len(some) > MAX_DAYS:
        low, high = days.agg(F.min(DAY), F.max(DAY)).first()
        return target.filter(F.col(DAY).between(F.lit(low), F.lit(high)) | F.col(DAY).isNull())
    named = F.col(DAY).isin([d for d in some if d is not None])
    return target.filter(named | F.col(DAY).isNull() if None in some else named)


def rows_to_store(
    df: DataFrame, path: str, keys: tuple[str, ...] = KEYS, order: tuple[str, ...] = ()
) -> DataFrame:
    """The rows whose key the stored table lacks."""
    target = stored(df.sparkSession, path)
    known = df.limit(0) if target is None else target if "timestamp" not in keys else on_days_of(target, df)
    return new_rows(df, known, keys, order)


def store_new(
    df: DataFrame, path: str, keys: tuple[str, ...] = KEYS, order: tuple[str, ...] = ()
) -> None:
    """Append the rows whose key the stored table lacks; repeating a call adds nothing.

    Only the days of the batch are read.  A null in a key is a value of its own.  One writer at a time: files carry no
    constraint, so two that store the same new key at once would both add it.
    """
    _append(rows_to_store(df, path, keys, order), path)


def store_unique(df: DataFrame, path: str, keys: tuple[str, ...] = KEYS) -> None:
    """Append the whole batch, or raise :class:`DuplicateKeys` and write nothing.  As ``store_new``, one writer at a time."""
    target = stored(df.sparkSession, path)
    bad = repeated_keys(df, keys)
    if target is not None:
        bad = bad.unionByName(clashes(df, target if "timestamp" not in keys else on_days_of(target, df), keys))
    if not bad.isEmpty():
        raise DuplicateKeys(f"keys {keys} repeat in the batch or exist in {path}")
    _append(df, path)


def seed_if_empty(df: DataFrame, path: str) -> bool:
    """Write ``df`` only where nothing is stored yet; say whether it was written."""
    target = stored(df.sparkSession, path)
    if target is not None and not target.isEmpty():
        return False
    _append(df, path)
    return True
