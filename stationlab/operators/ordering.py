"""Sorts and top-k.  Every limited sort names a tie-break, so its rows are fixed."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def newest(
    df: DataFrame, n: int, ts: str = "timestamp", ties: tuple[str, ...] = ("station",)
) -> DataFrame:
    """The ``n`` newest rows; planned as a top-k, not a full sort.

    Ties go to the smaller values of ``ties``, then of the other columns that have an order.
    """
    rest = [c for c, kind in df.dtypes if c != ts and c not in ties and not kind.startswith(("map", "variant"))]
    keys = [F.col(ts).desc(), *[F.col(t) for t in (*ties, *rest) if t in df.columns]]
    return df.orderBy(*keys).limit(n)


def strongest_first(df: DataFrame, measure: str, ts: str = "timestamp") -> DataFrame:
    return df.orderBy(F.col(measure).desc(), F.col(ts).desc())


def by_severity(alerts: DataFrame) -> DataFrame:
    """Most severe first, then latest start; unknown values lead."""
    return alerts.orderBy(F.desc_nulls_first("severite"), F.desc_nulls_first("debut"))
