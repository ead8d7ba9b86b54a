"""Stored metrics kept up to date: only the days that new readings can change are computed and written again.

A reading changes the frames of its own day and of the days whose frames reach back to it.  Those days, and the days before
them that their frames need, follow from the readings counted by station and day.  Anomaly flags depend on the
thresholds of all readings, so they are not stored; ``flagged`` adds them when the metrics are read.
"""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stationlab.operators.anomalies import flag_anomalies, thresholds
from stationlab.operators.blocks import BLOCK_ROWS
from stationlab.operators.filters import drop_incomplete
from stationlab.operators.joins import join_checked
from stationlab.operators.metrics import enrich
from stationlab.operators.summaries import daily_sketches, distinct_count
from stationlab.operators.windows import ROWS_30D, rolling_metrics
from stationlab.schemas import DAY, KEYS
from stationlab.session import checkpoint_folder
from stationlab.sinks.files import append_by_day, dated, rows_to_store, stored

FIRST_DAYS = 32
"""Days looked at on either side of the new readings, before looking four times as far."""
REACH_DAYS = 31
"""The frames of time mode end within so many days after a reading."""
PLACE = ["station", DAY]


def _cut(df: DataFrame) -> DataFrame:
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def _counts(table: DataFrame, touched: DataFrame, rows: int) -> DataFrame:
    """Complete readings by station and day, of touched stations, as far as ``rows`` readings on either side of what is touched."""
    low, high = touched.agg(F.min(DAY), F.max(DAY)).first()
    first, last = table.filter(F.col(DAY).isNotNull()).agg(F.min(DAY), F.max(DAY)).first()
    stations = touched.groupBy("station").agg(F.min(DAY).alias("_low"), F.max(DAY).alias("_high"))
    days = FIRST_DAYS
    while True:
        near = table.filter(F.col(DAY).between(F.date_sub(F.lit(low), days), F.date_add(F.lit(high), days)))
        counts = join_checked(drop_incomplete(near).select(*PLACE), stations.select("station"), ["station"], "left_semi")
        counts = _cut(counts.groupBy(*PLACE).agg(F.count("*").alias("n")))
        covers = (low - first).days <= days, (last - high).days <= days
        if all(covers):
            return counts
        beside = counts.join(stations, "station").groupBy("station").agg(
            F.sum(F.when(F.col(DAY) < F.col("_low"), F.col("n"))).alias("before"), F.sum(F.when(F.col(DAY) > F.col("_high"), F.col("n"))).alias("after")
        )
        few = [F.coalesce(c, F.lit(0)) < rows for c, whole in zip(("before", "after"), covers) if not whole]
        if beside.filter(few[0] if len(few) == 1 else few[0] | few[1]).isEmpty():
            return counts
        days *= 4


def places_by_rows(table: DataFrame, touched: DataFrame, rows: int = ROWS_30D) -> DataFrame:
    """(station, jour, changed): the places whose frames of ``rows`` earlier readings hold a touched one, and those these frames need."""
    counts = _counts(table, touched, rows).join(touched.select(*PLACE, F.lit(True).alias("_new")), PLACE, "left")
    line = Window.partitionBy("station").orderBy(DAY)
    upto, on = line.rowsBetween(Window.unboundedPreceding, 0), line.rowsBetween(0, Window.unboundedFollowing)
    marked = counts.withColumn("_end", F.sum("n").over(upto)).withColumn("_start", F.col("_end") - F.col("n"))
    latest = F.last(F.when(F.col("_new"), F.col("_end")), ignorenulls=True).over(upto)
    marked = marked.withColumn("changed", F.coalesce(F.col("_new") | (F.col("_start") - latest < rows), F.lit(False)))
    following = F.first(F.when(F.col("changed"), F.col("_start")), ignorenulls=True).over(on)
    marked = marked.withColumn("_needed", F.col("changed") | (following - F.col("_end") < rows))
    return marked.filter("_needed").select(*PLACE, "changed")


def places_by_days(touched: DataFrame, days: int = REACH_DAYS) -> DataFrame:
    """(station, jour, changed): touched days and those within ``days`` after, and as many before them."""
    def spread(low: int, high: int):
        return F.explode(F.sequence(F.date_add(DAY, low), F.date_add(DAY, high))).alias(DAY)

    changed = touched.select("station", spread(0, days)).distinct()
    needed = changed.select("station", spread(-days, 0)).distinct()
    return needed.join(changed.withColumn("changed", F.lit(True)), PLACE, "left").select(*PLACE, F.coalesce("changed", F.lit(False)).alias("changed"))


def _rolled(rows: DataFrame, mode: str, pressure_unit: str, block_rows: int) -> DataFrame:
    return enrich(rolling_metrics(rows, mode, block_rows=block_rows), pressure_unit)


def update_metrics(
    spark: SparkSession,
    table: str,
    results: str,
    touched: DataFrame,
    mode: str = "rows",
    pressure_unit: str = "Pa",
    block_rows: int = BLOCK_ROWS,
) -> None:
    """Bring the metrics stored at ``results`` up to date with the readings at ``table``.

    ``touched`` names the (station, jour) of new readings.  Days of ``results`` that no new reading can change stay
    as they are; the others are replaced as whole partitions, with the rows of untouched stations carried over.
    Without stored results all are computed.
    """
    readings = spark.read.parquet(table)
    known = stored(spark, results)
    if known is None:
        append_by_day(_rolled(drop_incomplete(readings), mode, pressure_unit, block_rows), results)
        return
    touched = _cut(touched.select(*PLACE).filter(F.col("station").isNotNull() & F.col(DAY).isNotNull()).distinct())
    if touched.isEmpty():
        return
    places = _cut(places_by_rows(readings, touched) if mode == "rows" else places_by_days(touched))
    changed = places.filter("changed").select(*PLACE)
    low, high, first, last = places.agg(
        F.min(DAY), F.max(DAY), F.min(F.when(F.col("changed"), F.col(DAY))), F.max(F.when(F.col("changed"), F.col(DAY)))
    ).first()
    if first is None:
        return
    rows = drop_incomplete(readings.filter(F.col(DAY).between(F.lit(low), F.lit(high))))
    rows = join_checked(rows, places.select(*PLACE), PLACE, "left_semi")
    fresh = join_checked(_rolled(rows, mode, pressure_unit, block_rows), changed, PLACE, "left_semi")
    days = changed.select(DAY).distinct()
    kept = known.filter(F.col(DAY).between(F.lit(first), F.lit(last))).join(F.broadcast(days), DAY, "left_semi")
    kept = join_checked(kept, changed, PLACE, "left_anti")
    # The rows to keep come from the partitions to replace: they are set down elsewhere first.
    replaced = _cut(fresh.select(known.columns).union(kept.select(known.columns)))
    append_by_day(replaced, results, "overwrite", partitionOverwriteMode="dynamic")


def pending_of(results: str) -> str:
    """Where the places that wait for their metrics are noted, beside the results."""
    return f"{results.rstrip('/')}-pending"


def sketches_of(table: str) -> str:
    """Where the daily sketches of a table's stations are kept, beside it."""
    return f"{table.rstrip('/')}-stations"


def stations_between(spark: SparkSession, table: str, low: str, high: str) -> DataFrame:
    """About how many stations reported from one day to another: read from the daily sketches, not from the readings."""
    days = F.col(DAY).between(F.lit(low).cast("date"), F.lit(high).cast("date"))
    return distinct_count(spark.read.parquet(sketches_of(table)).filter(days))


def store_and_update(
    df: DataFrame,
    table: str,
    results: str,
    mode: str = "rows",
    keys: tuple[str, ...] = KEYS,
    pressure_unit: str = "Pa",
    block_rows: int = BLOCK_ROWS,
) -> None:
    """Insert-or-ignore readings, then bring the stored metrics up to date.

    The places of new rows are noted before the rows are stored and cleared after their metrics are written, so a
    run that was cut off leaves nothing behind that the next one does not make good.  The new rows' daily sketches of
    stations are stored as well; rows that a cut-off run had already sketched change none of them.
    """
    spark = df.sparkSession
    fresh = _cut(dated(rows_to_store(df, table, keys)))
    fresh.select(*PLACE).distinct().write.mode("append").parquet(pending_of(results))
    append_by_day(daily_sketches(fresh), sketches_of(table))
    append_by_day(fresh, table)
    waiting = spark.read.schema("station string, jour date").parquet(pending_of(results))
    update_metrics(spark, table, results, waiting, mode, pressure_unit, block_rows)
    spark.createDataFrame([], "station string, jour date").coalesce(1).write.mode("overwrite").parquet(pending_of(results))


def flagged(spark: SparkSession, results: str, exact: bool = False) -> DataFrame:
    """Stored metrics with anomaly flags and scores by the thresholds of all of them."""
    rows = spark.read.parquet(results)
    return flag_anomalies(rows, thresholds(rows.select("temperature", "vitesse_vent", "pression"), exact=exact))
