"""Row filters.  Bounds are literals of the column's own type, so they reach the scan.

On a table stored by day (with a ``jour`` column of dates) the filters on time also name the days,
so that only those partitions are listed and read.
"""

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stationlab.schemas import DAY

AsOf = datetime | str


def moment(df: DataFrame, as_of: AsOf, ts: str = "timestamp") -> Column:
    """``as_of`` as a literal of the time column's type (with or without zone)."""
    text = as_of.isoformat(sep=" ") if isinstance(as_of, datetime) else as_of
    return F.lit(text).cast(df.schema[ts].dataType)


def interval(n: int, unit: str) -> Column:
    if unit not in {"hours", "days", "months"}:
        raise ValueError(f"unknown unit {unit!r}")
    return F.expr(f"INTERVAL {int(n)} {unit}")


def is_dated(df: DataFrame) -> bool:
    return DAY in df.columns and df.schema[DAY].dataType == T.DateType()


def on_days(df: DataFrame, low: Column | None = None, high: Column | None = None, ts: str = "timestamp") -> DataFrame:
    """The days from ``low`` to ``high`` (times) of a table stored by day; any other table as it is."""
    if not is_dated(df) or ts != "timestamp":
        return df
    for bound, keep in ((low, F.col(DAY).__ge__), (high, F.col(DAY).__le__)):
        if bound is not None:
            df = df.filter(keep(F.to_date(bound)))
    return df


def drop_incomplete(
    df: DataFrame, required: tuple[str, ...] = ("temperature", "timestamp", "station")
) -> DataFrame:
    """Rows that have every required value; plain null tests, so the scan can skip on them."""
    for name in required:
        df = df.filter(F.col(name).isNotNull())
    return df


def since(
    df: DataFrame, as_of: AsOf, n: int, unit: str = "days", ts: str = "timestamp"
) -> DataFrame:
    """Rows no older than ``n`` units before ``as_of``."""
    bound = moment(df, as_of, ts) - interval(n, unit)
    return on_days(df, bound, ts=ts).filter(F.col(ts) >= bound)


def in_period(df: DataFrame, start: AsOf, end: AsOf, ts: str = "timestamp") -> DataFrame:
    """Closed range of time."""
    low, high = moment(df, start, ts), moment(df, end, ts)
    return on_days(df, low, high, ts).filter(F.col(ts).between(low, high))


def on_day_before(df: DataFrame, as_of: AsOf, ts: str = "timestamp") -> DataFrame:
    """The calendar day before ``as_of``, as a range of the raw column so that it prunes."""
    today = F.date_trunc("day", moment(df, as_of, ts)).cast(df.schema[ts].dataType)
    before = today - interval(1, "days")
    return on_days(df, before, before, ts).filter((F.col(ts) >= before) & (F.col(ts) < today))


def above(df: DataFrame, measure: str, limit: float) -> DataFrame:
    return df.filter(F.col(measure) > F.lit(float(limit)))


def within(df: DataFrame, measure: str, low: float, high: float) -> DataFrame:
    """Closed range of a measure."""
    return df.filter(F.col(measure).between(F.lit(float(low)), F.lit(float(high))))


def of_station(df: DataFrame, station: str) -> DataFrame:
    return df.filter(F.col("station") == station)


def at_latest_time(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Rows carrying the newest time of the whole table, by one scalar subquery."""
    newest = df.agg(F.max(ts).alias("newest"))
    return df.filter(F.col(ts) == newest.scalar())


def active_alerts(alerts: DataFrame, as_of: AsOf) -> DataFrame:
    """Switched-on alerts that have not ended; an alert without an end counts."""
    open_ended = F.col("fin").isNull() | (F.col("fin") > moment(alerts, as_of, "fin"))
    return alerts.filter(F.col("active") & open_ended)


def unexpired_alerts(alerts: DataFrame, as_of: AsOf) -> DataFrame:
    """Alerts whose stated end lies at or after ``as_of``; one without an end drops out."""
    return alerts.filter(F.col("fin") >= moment(alerts, as_of, "fin"))
