"""Tables stored by day: pruned filters and inserts, streams stored once, metrics recomputed where they change."""

import os
import random

import pytest
from pyspark.sql import functions as F

from stationlab.operators import filters, summaries
from stationlab.operators.metrics import enrich
from stationlab.operators.windows import rolling_metrics
from stationlab.plans import jobs, questions, stored
from stationlab.schemas import DAY
from stationlab.sinks import files
from stationlab.streaming import store


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def hours(readings, days, stations=("a", "b"), first=0, step=1):
    return readings(
        *[
            (f"2024-{1 + d // 28:02d}-{1 + d % 28:02d} {h:02d}:00:00", s, 10.0 + (d * 24 + h) * 7919 % 100 / 10, 50.0, 101000.0, 3.0, 90.0, 0.0)
            for s in stations
            for d in range(first, days)
            for h in range(0, 24, step)
        ]
    )


def test_filters_on_time_prune_days(readings, tmp_path, spark):
    path = str(tmp_path / "t")
    files.write_readings(hours(readings, 20, step=6), path)
    assert len(parts(path)) == 20
    table = spark.read.parquet(path)
    for found, n in (
        (filters.since(table, "2024-01-20 12:00:00", 2), 2 * 10),
        (filters.on_day_before(table, "2024-01-10 05:00:00"), 2 * 4),
        (filters.in_period(table, "2024-01-03 06:00:00", "2024-01-04 06:00:00"), 2 * 5),
    ):
        assert f"PartitionFilters: [isnotnull({DAY}" in plan(found) and found.count() == n
    plain = table.drop(DAY)
    assert filters.since(plain, "2024-01-20 12:00:00", 2).count() == 2 * 10


def test_insert_reads_only_the_days_of_the_batch(readings, tmp_path, spark):
    path = str(tmp_path / "t")
    files.store_new(hours(readings, 10), path)
    batch = hours(readings, 10, first=9, stations=("a", "c"))
    found = files.rows_to_store(batch, path)
    assert "2024-01-10" in plan(found).split("PartitionFilters")[1][:200] and found.count() == 24
    files.store_new(batch, path)
    files.store_new(batch, path)
    assert spark.read.parquet(path).count() == 10 * 48 + 24
    many = hours(readings, 10)
    files.MAX_DAYS, kept = 3, files.MAX_DAYS
    try:
        assert files.rows_to_store(many, path).count() == 0
    finally:
        files.MAX_DAYS = kept


def test_null_keys_are_stored_once(readings, tmp_path, spark):
    path = str(tmp_path / "t")
    batch = readings((None, "a", 1.0), (None, "a", 2.0), ("2024-01-01 00:00:00", None, 3.0), (None, None, 4.0))
    for _ in range(2):
        files.store_new(batch, path)
    rows = spark.read.parquet(path)
    assert sorted(r.temperature for r in rows.collect()) == [1.0, 3.0, 4.0]
    assert rows.filter(f"{DAY} is null").count() == 2
    with pytest.raises(files.DuplicateKeys):
        files.store_unique(readings((None, "a", 9.0)), path)


def test_a_replayed_batch_adds_nothing(readings, tmp_path, spark):
    path = str(tmp_path / "t")
    first, second = hours(readings, 2), hours(readings, 3, first=1)
    assert store.store_batch(first, 0, path, "s") and store.store_batch(second, 1, path, "s")
    n = spark.read.parquet(path).count()
    assert not store.store_batch(second, 1, path, "s") and spark.read.parquet(path).count() == n == 3 * 48
    # The rows were stored, the note was lost: as after a crash between the two.
    assert store.store_batch(second, 1, path, "other") and spark.read.parquet(path).count() == n


def test_messages_into_a_stored_table(readings, tmp_path, spark):
    source, path = str(tmp_path / "in"), str(tmp_path / "t")
    value = F.to_json(F.struct("station", F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), "temperature"))
    rows = hours(readings, 1).unionByName(hours(readings, 1, stations=("a",)))
    sent = rows.select(F.col("station").alias("key"), value.alias("value"), F.lit("topic").alias("topic"), "timestamp")
    sent.write.parquet(source)
    messages = spark.readStream.schema(sent.schema).parquet(source)
    for _ in range(2):
        jobs.store_messages(messages, path, str(tmp_path / "check"), trigger=None).awaitTermination()
    assert spark.read.parquet(path).count() == 48


def parts(path):
    return {d: sorted(os.listdir(os.path.join(path, d))) for d in os.listdir(path) if d.startswith(DAY)}


def figures(df):
    names = ["station", "timestamp", "temp_moy_7j", "temp_moy_30j", "temp_volatilite_7j", "temp_volatilite_30j", "temp_tendance_24h"]
    return {(r.station, r.timestamp): [None if x is None else round(x, 9) for x in r[2:]] for r in df.select(*names).collect()}


@pytest.mark.parametrize("mode", ["rows", "time"])
def test_a_late_reading_changes_only_the_days_it_reaches(readings, tmp_path, spark, mode):
    table, results = str(tmp_path / "t"), str(tmp_path / "r")
    # One station of hourly, one of six-hourly readings: 720 rows are 30 and 180 days.
    start = hours(readings, 90, stations=("a",)).unionByName(hours(readings, 90, stations=("b",), step=6))
    late = F.col("timestamp") == F.lit("2024-02-10 05:00:00").cast("timestamp")
    stored.store_and_update(start.filter(~(late & (F.col("station") == "a"))), table, results, mode)
    before = parts(results)
    stored.store_and_update(start.filter(late & (F.col("station") == "a")), table, results, mode)
    after = parts(results)
    changed = sorted(d.split("=")[1] for d in after if after[d] != before.get(d))
    assert changed[0] == "2024-02-10" and "2024-02-09" not in changed and 30 <= len(changed) <= 33
    whole = enrich(rolling_metrics(start, mode))
    assert figures(spark.read.parquet(results)) == figures(whole)
    assert spark.read.parquet(results).count() == start.count()
    # Nothing new: nothing is written.
    stored.store_and_update(start, table, results, mode)
    assert parts(results) == after
    trends = questions.trends(spark.read.parquet(results), "2024-03-20 00:00:00")
    assert "PartitionFilters: [isnotnull(jour" in plan(trends) and trends.count() > 0


def test_scattered_late_readings_equal_a_full_run(readings, tmp_path, spark, monkeypatch):
    monkeypatch.setattr(stored, "FIRST_DAYS", 2)  # look farther step by step
    rng = random.Random(3)
    table, results = str(tmp_path / "t"), str(tmp_path / "r")
    rows = hours(readings, 150, stations=("a", "b", "c"), step=2).withColumn("_part", F.pmod(F.xxhash64("timestamp", "station"), F.lit(100)))
    rows = rows.checkpoint()
    picked = [0, 1] + [rng.randrange(2, 100)]
    stored.store_and_update(rows.filter(F.col("_part") > 1).drop("_part"), table, results)
    for p in (0, 1):
        batch = rows.filter((F.col("_part") == p) & ((F.col("station") == "a") | (F.col("timestamp") > "2024-05-01"))).drop("_part")
        stored.store_and_update(batch, table, results)
    assert picked and figures(spark.read.parquet(results)) == figures(rolling_metrics(spark.read.parquet(table)))


def test_a_run_cut_off_is_made_good(readings, tmp_path, spark, monkeypatch):
    table, results = str(tmp_path / "t"), str(tmp_path / "r")
    stored.store_and_update(hours(readings, 5), table, results)
    with monkeypatch.context() as m:
        m.setattr(stored, "update_metrics", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            stored.store_and_update(hours(readings, 6), table, results)
    stored.store_and_update(hours(readings, 6), table, results)
    assert spark.read.parquet(results).count() == 6 * 48
    assert stored.flagged(spark, results).filter("anomalie_temperature is null").count() == 0


def test_stations_are_counted_from_stored_sketches(readings, tmp_path, spark):
    table, results = str(tmp_path / "t"), str(tmp_path / "r")
    for stations in ("ab", "bc"):
        stored.store_and_update(hours(readings, 3, stations=tuple(stations), step=8), table, results)
    found = stored.stations_between(spark, table, "2024-01-01", "2024-01-02")
    assert found.first()[0] == 3 and "PartitionFilters: [isnotnull(jour" in plan(found)
    many = spark.range(200_000).select(
        F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id") % 172_800).alias("timestamp"), F.concat(F.lit("s"), F.col("id") % 50_000).alias("station")
    )
    sketches = summaries.daily_sketches(many)
    assert sketches.count() == 2
    assert summaries.distinct_count(sketches).first()[0] == pytest.approx(50_000, rel=0.05)
