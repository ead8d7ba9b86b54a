import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from stationlab.operators import blocks, frames, windows

METRICS = [
    "temp_moy_7j",
    "temp_volatilite_7j",
    "temp_moy_30j",
    "temp_volatilite_30j",
    "temp_tendance_24h",
]


def by_engine_rows(df, rows=(168, 720), back=24):
    """The same metrics with the engine's own sliding frames."""
    line = Window.partitionBy("station").orderBy("_us", "_tie")
    out = {}
    for n, (mean, deviation) in zip(rows, windows.METRIC_NAMES):
        frame = line.rowsBetween(-n, 0)
        out[mean] = F.avg("temperature").over(frame)
        out[deviation] = F.stddev_samp("temperature").over(frame)
    out["temp_tendance_24h"] = F.col("temperature") - F.lag("temperature", back).over(line)
    return blocks.ordered(df).withColumns(out).select(*df.columns, *out)


def by_engine_time(df):
    df = df.withColumn("_us", blocks.micros("timestamp"))
    line = Window.partitionBy("station").orderBy("_us")
    out = {}
    for days, (mean, deviation) in zip((7, 30), windows.METRIC_NAMES):
        frame = line.rangeBetween(-days * windows.DAY, 0)
        out[mean] = F.avg("temperature").over(frame)
        out[deviation] = F.stddev_samp("temperature").over(frame)
    past = line.rangeBetween(-30 * windows.HOUR, -24 * windows.HOUR)
    out["temp_tendance_24h"] = F.col("temperature") - F.max(F.struct("_us", "temperature")).over(past)["temperature"]
    return df.withColumns(out).drop("_us")


def rows_of(df, keys=("station", "timestamp", "humidite")):
    return sorted(df.select(*keys, *METRICS).collect(), key=lambda r: tuple(str(r[k]) for k in keys))


def as_numbers(row):
    """Sort key by station, time and all values, to six digits."""
    return (row[0], row[1], *[-1e9 if v is None else round(v, 6) for v in row[2:]])


def assert_close(ours, theirs):
    assert len(ours) == len(theirs)
    for a, b in zip(ours, theirs):
        assert a[:3] == b[:3]
        for x, y in zip(a[3:], b[3:]):
            assert (x is None) == (y is None), (a, b)
            assert x is None or math.isclose(x, y, abs_tol=1e-8), (a, b)


@pytest.fixture(scope="module")
def busy(spark):
    """One station with most rows and a burst of them in one second, and two light ones."""
    generator = random.Random(5)
    rows = []
    for i in range(4000):
        rows.append(("heavy", i * 1800.0, generator.gauss(15, 8), float(i)))
    for i in range(2500):
        rows.append(("heavy", 3_000_000.0 + i / 2500, generator.gauss(10, 3), 10_000.0 + i))
    for i in range(900):
        rows.append(("steady", i * 3600.0, 21.5 if i > 60 else 20.0, float(i)))
    rows.append(("single", 0.0, 3.0, 0.0))
    df = spark.createDataFrame(rows, "station string, s double, temperature double, humidite double")
    return df.select(
        F.timestamp_micros((F.col("s") * 1_000_000).cast("long") + 1_704_067_200_000_000).alias("timestamp"),
        "station",
        "temperature",
        "humidite",
    )


@pytest.mark.parametrize("block_rows", [500_000, 2_000, 1_500])
def test_rows_mode_equals_engine_frames(busy, block_rows):
    ours = windows.rolling_metrics(busy, "rows", block_rows=block_rows)
    assert_close(rows_of(ours), rows_of(by_engine_rows(busy)))


@pytest.mark.parametrize("block_rows", [500_000, 2_000])
def test_time_mode_equals_engine_frames(busy, block_rows):
    ours = windows.rolling_metrics(busy, "time", block_rows=block_rows)
    assert_close(rows_of(ours), rows_of(by_engine_time(busy)))


def test_same_time_rows_are_split_too(spark):
    """A third of all rows at one instant of one station still spreads over blocks."""
    df = spark.range(9000).select(
        F.timestamp_seconds(F.when(F.col("id") % 3 == 0, 1_704_067_200).otherwise(1_704_067_200 + F.col("id") * 60))
        .alias("timestamp"),
        F.lit("s").alias("station"),
        (F.col("id") * 7919 % 451 / 10).cast("double").alias("temperature"),
        F.col("id").cast("double").alias("humidite"),
    )
    lines = blocks.ordered(df)
    plan = blocks.plan_blocks(lines, 100, block_rows=1000)
    assert plan.cut
    sizes = [r["n"] for r in plan.place(lines).filter("not _halo").groupBy("_block").agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 9000 and max(sizes) < 2500
    ours = windows.rolling_metrics(df, "rows", block_rows=2000)
    assert_close(rows_of(ours), rows_of(by_engine_rows(df)))
    in_time = windows.rolling_metrics(df, "time", block_rows=2000)
    assert_close(rows_of(in_time), rows_of(by_engine_time(df)))


def test_time_mode_moves_rows_once(busy):
    """One exchange by (key, granule) for rows and their copies, beside those of the small table of granules."""
    plan = windows.rolling_metrics(busy, "time")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(_key") == 2


def test_time_mode_spreads_over_tasks_as_rows_ask(busy, monkeypatch):
    monkeypatch.setattr(windows, "TASK_EVENTS", 4 * busy.count() // 12)
    ours = windows.rolling_metrics(busy, "time")
    plan = ours._jdf.queryExecution().executedPlan().toString()
    tasks = [int(x) for x in re.findall(r"hashpartitioning\(_key#\d+, _g#\d+L, (\d+)\), REPARTITION_BY_NUM", plan)]
    assert tasks and min(tasks) >= 12
    assert_close(rows_of(ours), rows_of(by_engine_time(busy)))


def test_copies_of_one_row_are_split_too(spark):
    """A third of all rows are copies of one row; no block takes them all."""
    df = spark.range(9000).select(
        F.timestamp_seconds(F.when(F.col("id") % 3 == 0, 1_704_100_000).otherwise(1_704_067_200 + F.col("id") * 60))
        .alias("timestamp"),
        F.lit("s").alias("station"),
        F.when(F.col("id") % 3 == 0, 12.5).otherwise((F.col("id") * 7919 % 451 / 10).cast("double")).alias("temperature"),
        F.when(F.col("id") % 3 == 0, 0.0).otherwise(F.col("id").cast("double")).alias("humidite"),
    )
    lines = blocks.ordered(df)
    plan = blocks.plan_blocks(lines, 100, block_rows=500)
    assert plan.crowded is not None
    placed = plan.place(lines).filter("not _halo")
    sizes = [r["n"] for r in placed.groupBy("_block").agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 9000 and max(sizes) <= 1000
    shown = ["station", "timestamp", "temperature", "humidite"]
    assert placed.select(*shown).exceptAll(df.select(*shown)).isEmpty()
    # Copies are alike, so compare the rows as a bag: the engine's order among them is free.
    for mode, engine in (("rows", by_engine_rows), ("time", by_engine_time)):
        ours = windows.rolling_metrics(df, mode, block_rows=2000)
        theirs = engine(df)
        assert_close(sorted(rows_of(ours), key=as_numbers), sorted(rows_of(theirs), key=as_numbers))


def test_frames_equal_plain_sums():
    """Missing, constant, extreme and huge values, lines shorter and longer than frames."""
    rng = np.random.default_rng(3)
    for size in (0, 1, 2, 6, 7, 8, 50, 700):
        line = rng.normal(5, 2, size)
        line[rng.random(size) < 0.2] = np.nan
        if size > 20:
            line[10:16], line[20], line[size // 2] = 3.3, 1e17, np.inf
        for rows in (0, 1, 6, 24):
            mean, deviation = frames.rolling(line, rows)
            for i in range(size):
                known = [x for x in line[max(0, i - rows) : i + 1] if math.isfinite(x)]
                assert (np.isnan(mean[i]) and not known) or math.isclose(mean[i], math.fsum(known) / len(known), rel_tol=1e-12, abs_tol=1e-12)
                if len(known) < 2:
                    assert np.isnan(deviation[i])
                else:
                    centre = math.fsum(known) / len(known)
                    plain = math.sqrt(math.fsum((x - centre) ** 2 for x in known) / (len(known) - 1))
                    assert math.isclose(deviation[i], plain, rel_tol=1e-9, abs_tol=1e-9), (size, rows, i)


def test_constant_frames_have_zero_deviation(busy):
    steady = windows.rolling_metrics(busy.filter("station = 'steady'"))
    late = steady.filter("humidite > 800").collect()
    assert all(r["temp_volatilite_30j"] == 0.0 and r["temp_moy_30j"] == 21.5 for r in late)


def test_single_row_and_short_history(readings):
    rows = [(f"2024-01-01 {h:02d}:00:00", "a", float(h)) for h in range(24)]
    out = windows.rolling_metrics(readings(*rows)).orderBy("timestamp").collect()
    assert out[0]["temp_volatilite_7j"] is None and out[0]["temp_moy_7j"] == 0.0
    assert all(r["temp_tendance_24h"] is None for r in out)


def test_missing_values_do_not_spread(readings):
    rows = [(f"2024-01-01 {h:02d}:00:00", "a", t) for h, t in enumerate([1.0, None, float("nan"), 4.0])]
    for mode in ("rows", "time"):
        out = windows.rolling_metrics(readings(*rows), mode).orderBy("timestamp").collect()
        assert [r["temp_moy_7j"] for r in out] == [1.0, 1.0, 1.0, 2.5], mode


def test_mean_lies_within_the_frame(busy):
    line = Window.partitionBy("station").orderBy("_us", "_tie").rowsBetween(-168, 0)
    checked = blocks.ordered(windows.rolling_metrics(busy)).withColumns(
        {"lo": F.min("temperature").over(line), "hi": F.max("temperature").over(line)}
    )
    # The tie hash differs with the added columns, so look at distinct times only.
    single = checked.groupBy("station", "timestamp").count().filter("count = 1")
    plain = checked.filter("humidite < 1500 AND station = 'heavy'").join(single, ["station", "timestamp"], "left_semi")
    assert plain.filter("temp_moy_7j < lo - 1e-9 OR temp_moy_7j > hi + 1e-9").isEmpty()


def test_blocks_need_room_for_the_halo(busy):
    with pytest.raises(ValueError):
        windows.rolling_metrics(busy, block_rows=1000)


def test_a_worker_gets_a_bounded_block(spark, monkeypatch):
    seen, plain = [], windows.plan_blocks

    def plan(lines, halo, key="station", block_rows=None):
        blocks = plain(lines, halo, key, block_rows)
        place = type(blocks).place
        seen.append(max(r["count"] for r in place(blocks, lines).groupBy(key, "_block").count().collect()))
        return blocks

    monkeypatch.setattr(windows, "plan_blocks", plan)
    monkeypatch.setattr(windows, "WORKER_ROWS", 4_000)
    start = F.lit("2024-01-01").cast("timestamp")
    df = spark.range(40_000).select(
        F.lit("a").alias("station"),
        F.timestamp_micros(F.unix_micros(start) + F.col("id") * 60_000_000).alias("timestamp"),
        (F.hash("id") % 1000 / 10.0).alias("temperature"),
    )
    line = Window.partitionBy("station").orderBy("timestamp")
    steps = df.withColumn("variation", F.col("temperature") - F.lag("temperature").over(line))
    plainly = steps.withColumn("variation_volatilite", F.stddev_samp("variation").over(line.rowsBetween(-windows.ROWS_7D, 0)))
    got = windows.variation_volatility(df)
    gaps = got.join(plainly.drop("temperature", "station"), "timestamp").filter(
        ~(F.abs(got["variation_volatilite"] - plainly["variation_volatilite"]) < 1e-9)
    )
    assert got.count() == 40_000 and gaps.count() == 0
    assert max(seen) <= 2 * 4_000 + 169


def test_variation_volatility(readings):
    rows = [(f"2024-01-01 {h:02d}:00:00", "a", float(t)) for h, t in enumerate([1, 3, 2, 6])]
    out = windows.variation_volatility(readings(*rows)).orderBy("timestamp").collect()
    assert [r["variation"] for r in out] == [None, 2.0, -1.0, 4.0]
    assert out[1]["variation_volatilite"] is None
    assert math.isclose(out[3]["variation_volatilite"], 2.516611478423583)
