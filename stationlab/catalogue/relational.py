"""Projections, filters, joins, set operations and the relational side of the sinks."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from stationlab import adapters
from stationlab.catalogue.registry import ALERTS_AS_OF, AS_OF, query, r
from stationlab.operators import dedup, filters, intervals, joins, ordering
from stationlab.schemas import READINGS
from stationlab.sources.tables import read_table

NOW = f"TIMESTAMP '{AS_OF}'"
TS = '"timestamp"'


def readings(spark, folder):
    return adapters.readings(spark, folder)


def narrow(df):
    return df.select("station", "timestamp", "temperature")


NARROW = f"SELECT station, {TS}, {r('temperature')} FROM readings"


@query("S7_read_table", NARROW, ("readings",))
def stored_table(spark, folder):
    readings(spark, folder).createOrReplaceTempView("mesures_stockees")
    return narrow(read_table(spark, "mesures_stockees"))


WIRE_SQL = ", ".join(
    r(c) for c in ("temperature", "humidite", "pression", "vitesse_vent", "direction_vent", "precipitation")
)


@query("P2_wire_columns", f"SELECT station, {TS}, {WIRE_SQL} FROM readings", ("readings",))
def wire_columns(spark, folder):
    return readings(spark, folder).select(*READINGS.names)


def register_filter(name, condition, build):
    query(name, f"{NARROW} WHERE {condition}", ("readings",))(
        lambda spark, folder: narrow(build(readings(spark, folder)))
    )


register_filter(
    "F1_drop_incomplete",
    f"temperature IS NOT NULL AND {TS} IS NOT NULL AND station IS NOT NULL",
    filters.drop_incomplete,
)
for n, unit in ((24, "hours"), (7, "days"), (30, "days"), (12, "months")):
    register_filter(
        f"F2_since_{n}_{unit}",
        f"{TS} >= {NOW} - INTERVAL {n} {unit}",
        lambda df, n=n, unit=unit: filters.since(df, AS_OF, n, unit),
    )
register_filter(
    "F3_in_period",
    f"{TS} BETWEEN TIMESTAMP '2024-01-10 06:00:00' AND TIMESTAMP '2024-01-20 18:00:00'",
    lambda df: filters.in_period(df, "2024-01-10 06:00:00", "2024-01-20 18:00:00"),
)
register_filter(
    "F9_temperature_range",
    "temperature BETWEEN 18 AND 24",
    lambda df: filters.within(df, "temperature", 18, 24),
)
register_filter(
    "F9_humidity_range",
    "humidite BETWEEN 40 AND 60",
    lambda df: filters.within(df, "humidite", 40, 60),
)


@query("O1_newest_100", f"{NARROW} ORDER BY {TS} DESC, station LIMIT 100", ("readings",))
def newest(spark, folder):
    return narrow(ordering.newest(readings(spark, folder), 100))


@query(
    "O3_date_then_station",
    f"""SELECT CAST({TS} AS DATE) AS date, station, count(*) AS nb_mesures FROM readings GROUP BY ALL""",
    ("readings",),
)
def date_then_station(spark, folder):
    per_day = (
        readings(spark, folder)
        .groupBy(F.to_date("timestamp").alias("date"), "station")
        .agg(F.count("*").alias("nb_mesures"))
    )
    return per_day.orderBy(F.desc("date"), "station")


@query(
    "P6_J1_station_dimension",
    f"SELECT station, upper(station) AS station_name, {TS}, {r('temperature')} FROM readings",
    ("readings",),
)
def station_dimension(spark, folder):
    catalogue = adapters.station_catalogue(adapters.table(spark, folder, "events"))
    bare = readings(spark, folder).drop("station_name")
    return joins.with_station_name(bare, catalogue).select(
        "station", "station_name", "timestamp", "temperature"
    )


def hourly(df):
    """Readings keyed by the hour, several to a key."""
    return df.select(
        F.date_trunc("hour", "timestamp").cast("timestamp_ntz").alias("timestamp"),
        "station",
        F.col("timestamp").alias("mesure_le"),
        "temperature",
        "humidite",
    )


HOURLY_COLUMNS = f"{TS}, station, mesure_le, {r('temperature')}, {r('humidite')}"
FIRST = f"""first_rows AS (SELECT * FROM hourly
  QUALIFY row_number() OVER (PARTITION BY {TS}, station ORDER BY mesure_le) = 1)"""


@query("U2_first_per_key", f"SELECT {HOURLY_COLUMNS} FROM hourly QUALIFY row_number() OVER "
       f"(PARTITION BY {TS}, station ORDER BY mesure_le) = 1", ("hourly",))  # fmt: skip
def first_per_key(spark, folder):
    return dedup.first_per_key(hourly(readings(spark, folder)), order=("mesure_le",))


# The collector re-sends everything; the target holds what came before the cut, with
# the last reading of each hour, so a kept row differs from the one that is ignored.
CUT = "2024-01-15 00:00:00"
TARGET_SQL = f"""(SELECT * FROM hourly WHERE {TS} < TIMESTAMP '{CUT}'
  QUALIFY row_number() OVER (PARTITION BY {TS}, station ORDER BY mesure_le DESC) = 1)"""


def stored_before_cut(df):
    old = hourly(df).filter(F.col("timestamp") < F.lit(CUT).cast("timestamp_ntz"))
    newest_row = F.max(F.struct("mesure_le", "temperature", "humidite")).alias("_row")
    return old.groupBy("timestamp", "station").agg(newest_row).select("timestamp", "station", "_row.*")


@query(
    "K5_J3_insert_or_ignore",
    f"""SELECT {HOURLY_COLUMNS} FROM (
      SELECT * FROM {TARGET_SQL}
      UNION ALL
      SELECT i.* FROM (SELECT * FROM hourly
        QUALIFY row_number() OVER (PARTITION BY {TS}, station ORDER BY mesure_le) = 1) i
      WHERE NOT EXISTS (SELECT 1 FROM hourly h WHERE h.{TS} < TIMESTAMP '{CUT}'
        AND h.{TS} = i.{TS} AND h.station = i.station))""",
    ("hourly",),
)
def insert_or_ignore(spark, folder):
    df = readings(spark, folder)
    return dedup.insert_or_ignore(hourly(df), stored_before_cut(df), order=("mesure_le",))


@query(
    "K6_J7_clashing_keys",
    f"SELECT DISTINCT {TS}, station FROM hourly WHERE {TS} < TIMESTAMP '{CUT}'",
    ("hourly",),
)
def clashing_keys(spark, folder):
    df = readings(spark, folder)
    return dedup.clashes(hourly(df), stored_before_cut(df))


@query(
    "U1_union_all",
    f"""SELECT station, {TS}, {r('temperature')}, {r('humidite')}, source FROM (
      SELECT station, {TS}, temperature, humidite, 'complete' AS source FROM readings
      UNION ALL SELECT station, {TS}, temperature, NULL, 'partielle' FROM readings)""",
    ("readings",),
)
def union(spark, folder):
    full = readings(spark, folder).select("station", "timestamp", "temperature", "humidite")
    return dedup.union_all(
        [
            full.withColumn("source", F.lit("complete")),
            full.drop("humidite").withColumn("source", F.lit("partielle")),
        ]
    )


@query(
    "J5_event_association",
    f"""SELECT u.event_id AS id_evenement, count(r.{TS}) AS nb_mesures, {r('avg(r.temperature)', 'moyenne')}
    FROM events u LEFT JOIN readings r ON r.station = u.event_type AND r.{TS} >= u.ts
      AND r.{TS} < u.ts + to_minutes(CAST(u.event_id % 60 AS INT))
    GROUP BY u.event_id""",
    ("readings",),
)
def association(spark, folder):
    events = adapters.urban_events(adapters.table(spark, folder, "events"))
    return intervals.event_stats(readings(spark, folder), events, "id_evenement")


@query(
    "J5_alerts_per_zone",
    f"""SELECT a.id, count(z.instant) AS nb_mesures, {r('avg(z.prix)', 'moyenne')}
    FROM alerts a LEFT JOIN (
        SELECT 'zone_' || CAST(o_custkey % 10 AS VARCHAR) AS zone, o_orderdate AS instant,
          o_totalprice AS prix FROM orders) z
      ON z.zone = a.zone AND z.instant >= a.debut AND (a.fin IS NULL OR z.instant < a.fin)
    GROUP BY a.id""",
    ("alerts",),
)
def alerts_per_zone(spark, folder):
    # Orders stand for measures of a zone; open alerts reach to the end of the table.
    table = adapters.alerts(spark, folder)
    measures = adapters.table(spark, folder, "orders").select(
        F.concat(F.lit("zone_"), (F.col("o_custkey") % 10).cast("string")).alias("zone"),
        F.col("o_orderdate").alias("timestamp"),
        F.col("o_totalprice").alias("prix"),
    )
    return intervals.event_stats(measures, table, "id", "prix", "zone")


@query(
    "O4_alerts_by_severity",
    """SELECT id, severite, debut, row_number() OVER (
      PARTITION BY severite, date_trunc('day', debut) ORDER BY debut DESC NULLS FIRST, id) AS rang
    FROM alerts""",
    ("alerts",),
)
def severity_report(spark, folder):
    """All alerts, most severe first, with their rank among those of a severity and start day."""
    day = Window.partitionBy("severite", F.to_date("debut")).orderBy(F.desc_nulls_first("debut"), "id")
    ranked = adapters.alerts(spark, folder).withColumn("rang", F.row_number().over(day))
    return ordering.by_severity(ranked).select("id", "severite", "debut", "rang")


@query(
    "F7_active_alert_variants",
    f"""SELECT id, 'en_cours' AS regle FROM alerts
      WHERE active AND (fin IS NULL OR fin > TIMESTAMP '{ALERTS_AS_OF}')
    UNION ALL SELECT id, 'non_echue' FROM alerts WHERE fin >= TIMESTAMP '{ALERTS_AS_OF}'""",
    ("alerts",),
)
def alert_variants(spark, folder):
    table = adapters.alerts(spark, folder)
    running = filters.active_alerts(table, ALERTS_AS_OF).select("id", F.lit("en_cours").alias("regle"))
    unexpired = filters.unexpired_alerts(table, ALERTS_AS_OF).select("id", F.lit("non_echue").alias("regle"))
    return dedup.union_all([running, unexpired])
