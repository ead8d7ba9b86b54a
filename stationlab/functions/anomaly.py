"""Flags and scores against thresholds.

A flag is never null: a null reading is not an anomaly.  A score is the excess
over the crossed threshold relative to that threshold, sign included; a zero
threshold gives null and an uncrossed one gives 0.0.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_outside(x: Column, low: Column, high: Column) -> Column:
    return F.coalesce((x < low) | (x > high), F.lit(False))


def is_above(x: Column, high: Column) -> Column:
    return F.coalesce(x > high, F.lit(False))


def score_outside(x: Column, low: Column, high: Column) -> Column:
    return (
        F.when(x < low, F.try_divide(low - x, low))
        .when(x > high, F.try_divide(x - high, high))
        .otherwise(F.lit(0.0))
    )


def score_above(x: Column, high: Column) -> Column:
    return F.when(x > high, F.try_divide(x - high, high)).otherwise(F.lit(0.0))
