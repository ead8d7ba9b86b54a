"""Extreme and missing readings stay inside the frames and events that hold them."""

import pytest
from pyspark.sql import functions as F

from stationlab.operators import intervals, windows


@pytest.fixture(scope="module")
def hourly(spark):
    rows = [("a", i, 10.0 + (i * 7919) % 1000 / 100) for i in range(1500)]
    rows += [("b", i, 0.0) for i in range(300)]
    df = spark.createDataFrame(rows, "station string, h int, temperature double")
    at = F.timestamp_micros(F.col("h").cast("long") * 3_600_000_000 + 1_704_067_200_000_000)
    return df.select(at.alias("timestamp"), "station", "h", "temperature")


@pytest.mark.parametrize("mode", ["rows", "time"])
@pytest.mark.parametrize("bad", [1e9, 1e17, float("nan")])
def test_a_fault_changes_only_the_frames_that_hold_it(hourly, mode, bad):
    def figures(df):
        rolled = windows.rolling_metrics(df, mode)
        names = [n for pair in windows.METRIC_NAMES for n in pair]
        return {(r.station, r.h): r[2:] for r in rolled.select("station", "h", *names).collect()}

    fault = (F.col("station") == "a") & (F.col("h") == 300)
    spoilt = hourly.withColumn("temperature", F.when(fault, bad).otherwise(F.col("temperature")))
    good, found = figures(hourly), figures(spoilt)
    for (station, h), row in good.items():
        if station == "b" or h < 300 or h > 300 + 168:
            assert found[station, h][:2] == pytest.approx(row[:2], abs=1e-9), (station, h)
        if station == "b" or h < 300 or h > 300 + 720:
            assert found[station, h][2:] == pytest.approx(row[2:], abs=1e-9), (station, h)


@pytest.mark.parametrize("bad", [1e17, float("nan")])
def test_a_fault_changes_only_the_events_that_hold_it(spark, hourly, bad):
    events = spark.createDataFrame(
        [(1, "a", "2024-01-02 00:00:00", "2024-01-05 00:00:00"), (2, "a", "2024-01-12 00:00:00", "2024-01-14 00:00:00"), (3, "a", "2024-01-20 00:00:00", None)],
        "id int, station string, debut string, fin string",
    ).withColumns({c: F.col(c).cast("timestamp") for c in ("debut", "fin")})
    spoilt = hourly.withColumn("temperature", F.when(F.col("h") == 300, bad).otherwise(F.col("temperature")))
    good = {r.id: r for r in intervals.event_stats(hourly, events, "id").collect()}
    found = {r.id: r for r in intervals.event_stats(spoilt, events, "id").collect()}
    assert found[1] == good[1] and found[3] == good[3]
    assert found[2].nb_mesures == good[2].nb_mesures and found[2].moyenne != good[2].moyenne


def test_small_deviations_beside_large_means_are_kept(spark):
    rows = [(i, 1e6 + 0.2 * (i % 2)) for i in range(200)]
    df = spark.createDataFrame(rows, "h int, temperature double").select(
        F.timestamp_micros(F.col("h").cast("long") * 3_600_000_000).alias("timestamp"), F.lit("a").alias("station"), "h", "temperature"
    )
    for mode in ("rows", "time"):
        last = windows.rolling_metrics(df, mode).filter("h = 199").first()
        assert last.temp_volatilite_7j == pytest.approx(0.1003, abs=1e-3)
