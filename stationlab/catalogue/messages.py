"""Messages, landed pages and files: what is written and read again equals the readings it came from."""

import uuid

from pyspark.sql import functions as F

from stationlab import adapters
from stationlab.catalogue.registry import AS_OF, query, r
from stationlab.functions import from_epoch_millis, has_entity, nan_to_null, or_default, parse_timestamp
from stationlab.functions.convert import terms
from stationlab.operators import anomalies
from stationlab.operators.dedup import union_all
from stationlab.operators.filters import drop_incomplete, since
from stationlab.operators.metrics import enrich
from stationlab.operators.ordering import newest
from stationlab.plans import stored
from stationlab.schemas import API_MEASURES, MEASURES, READINGS, TOPIC_ALERTS, TOPIC_READINGS, TOPIC_URBAN
from stationlab.session import checkpoint_folder
from stationlab.sinks import files as sinks
from stationlab.sinks.external import to_messages
from stationlab.sources import files as sources
from stationlab.streaming import messages as parsing
from stationlab.streaming import windows

TS = '"timestamp"'
SHOWN = ", ".join(r(m) for m in MEASURES)


def _folder(spark, what: str) -> str:
    return f"{checkpoint_folder(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def sent(spark, folder):
    """Every reading as a message of bytes, arriving a minute later; topics in turn."""
    readings = adapters.readings(spark, folder)
    values = to_messages(readings.select(*READINGS.names)).select("key", F.col("value").cast("binary").alias("value"))
    minute = F.minute(F.try_to_timestamp(F.get_json_object(F.col("value").cast("string"), "$.timestamp")))
    topic = F.when(minute % 5 < 3, TOPIC_READINGS).when(minute % 5 < 4, TOPIC_ALERTS).otherwise(TOPIC_URBAN)
    at = F.try_to_timestamp(F.get_json_object(F.col("value").cast("string"), "$.timestamp")) + F.expr("INTERVAL 1 MINUTE")
    return values.select("key", "value", topic.alias("topic"), at.alias("timestamp"))


TOPIC_SQL = f"""CASE WHEN minute({TS}) % 5 < 3 THEN '{TOPIC_READINGS}'
  WHEN minute({TS}) % 5 < 4 THEN '{TOPIC_ALERTS}' ELSE '{TOPIC_URBAN}' END"""


@query(
    "K3_T1_P4_X11_X12_X13_X14_messages",
    f"SELECT station, {TS}, {SHOWN}, {TS} + INTERVAL 1 MINUTE AS kafka_timestamp FROM readings",
    ("readings",),
)
def message_round_trip(spark, folder):
    return parsing.parse_readings(sent(spark, folder))


@query(
    "T2_enriched_messages",
    f"""SELECT station, {TS}, indice_confort, risque_precipitation, {r('temperature_ressentie')} FROM enriched
    WHERE minute({TS}) % 5 < 3""",
    ("enriched",),
)
def enriched_messages(spark, folder):
    rows = drop_incomplete(parsing.readings_of(sent(spark, folder)))
    return enrich(rows).select("station", "timestamp", "indice_confort", "risque_precipitation", "temperature_ressentie")


@query(
    "T9_S6_routes",
    f"""SELECT 'readings' AS route, count(*) AS n, count(temperature) AS connus FROM readings WHERE minute({TS}) % 5 < 3
    UNION ALL SELECT 'alerts', count(*), 0 FROM readings WHERE minute({TS}) % 5 = 3
    UNION ALL SELECT 'others', count(*), 0 FROM readings WHERE minute({TS}) % 5 = 4""",
    ("readings",),
)
def routes(spark, folder):
    known = {"readings": F.count("temperature"), "alerts": F.count(F.nullif("type_alerte", F.lit("Unknown"))), "others": F.count(F.lit(None))}
    return union_all(
        [
            project(sent(spark, folder)).agg(F.count("*").alias("n"), known[name].alias("connus")).select(F.lit(name).alias("route"), "n", "connus")
            for name, project in parsing.ROUTES.items()
        ]
    )


@query("T11_message_counts", f"SELECT {TOPIC_SQL} AS topic, count(*) AS nb_messages FROM readings GROUP BY ALL", ("readings",))
def counts(spark, folder):
    return parsing.message_counts(sent(spark, folder))


STATS = f"""count(*) AS nb_mesures, {r('avg(temperature)', 'temp_moyenne')}, {r('stddev_samp(temperature)', 'temp_volatilite')},
  {r('min(temperature)', 'temp_min')}, {r('max(temperature)', 'temp_max')}"""


@query(
    "T6_tumbling_windows",
    f"""SELECT station, CAST(date_trunc('hour', {TS}) AS TIMESTAMP) AS debut,
      CAST(date_trunc('hour', {TS}) AS TIMESTAMP) + INTERVAL 1 HOUR AS fin, {STATS} FROM readings GROUP BY ALL""",
    ("readings",),
)
def tumbling(spark, folder):
    return windows.tumbling_stats(adapters.readings(spark, folder))


@query(
    "T6_sliding_windows",
    f"""SELECT station, CAST(date_trunc('day', {TS}) AS TIMESTAMP) - to_days(CAST(k AS INT)) AS debut,
      CAST(date_trunc('day', {TS}) AS TIMESTAMP) + to_days(CAST(7 - k AS INT)) AS fin, {STATS}
    FROM readings, (SELECT unnest(range(7)) AS k) GROUP BY ALL""",
    ("readings",),
)
def sliding(spark, folder):
    return windows.sliding_stats(adapters.readings(spark, folder))


FLAGS = ("anomalie_temperature", "anomalie_vent", "anomalie_pression")


@query("T12_stored_thresholds", f"SELECT station, {TS}, {', '.join(FLAGS)} FROM flagged", ("flagged",))
def stored_thresholds(spark, folder):
    rows = drop_incomplete(adapters.readings(spark, folder))
    path = _folder(spark, "thresholds")
    anomalies.thresholds(rows, exact=True).write.parquet(path)
    return windows.flag_with_stored(rows, spark.read.parquet(path)).select("station", "timestamp", *FLAGS)


@query("X15_epoch_millis", "SELECT event_id, date_trunc('milliseconds', ts) AS instant FROM events")
def epoch_millis(spark, folder):
    millis = F.unix_millis(F.col("ts").cast("timestamp"))
    return adapters.table(spark, folder, "events").select("event_id", from_epoch_millis(millis).alias("instant"))


@query(
    "X20_default_value",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'Unknown' ELSE o_orderstatus END AS type_alerte FROM orders",
)
def default_value(spark, folder):
    missing = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderstatus"))
    return adapters.table(spark, folder, "orders").select("o_orderkey", or_default(missing).alias("type_alerte"))


@query(
    "X22_entity_membership",
    r"""SELECT doc_id, coalesce(list_contains(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), 'the'), false) AS cite
    FROM documents""",
)
def entity_membership(spark, folder):
    return adapters.table(spark, folder, "documents").select("doc_id", has_entity(terms("text"), "the").alias("cite"))


@query("X26_nan_is_missing", f"SELECT event_id, {r('CASE WHEN event_id % 7 <> 0 THEN value END', 'mesure')} FROM events")
def nan_is_missing(spark, folder):
    spoilt = F.when(F.col("event_id") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    return adapters.table(spark, folder, "events").select("event_id", nan_to_null(spoilt).alias("mesure"))


def landed(spark, folder):
    """Every reading as a landed record: times two hours ahead of UTC, numbers as text, some not a number."""
    readings = adapters.readings(spark, folder)
    ahead = F.concat(F.date_format(F.col("timestamp") + F.expr("INTERVAL 2 HOURS"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+02:00"))
    text = {
        field: F.when(F.second("timestamp") == 0, F.lit("n/a")).otherwise(F.col(name).cast("string")) if name in MEASURES else F.lit(None).cast("string")
        for field, name in API_MEASURES.items()
    }
    labels = {"type_de_station": F.lit("fixe"), "heure_de_paris": F.lit(None).cast("string")}
    return readings.select("station", ahead.alias("heure_utc"), *[c.alias(n) for n, c in (text | labels).items()])


LANDED_SQL = ", ".join(r(f"CASE WHEN second({TS}) <> 0 THEN {m} END", m) for m in MEASURES)


@query("P1_S3_landed_records", f"SELECT station, {TS}, {LANDED_SQL}, 'fixe' AS station_type FROM readings", ("readings",))
def landed_records(spark, folder):
    rows = sources.project_api_records(landed(spark, folder), "station")
    return rows.select("station", "timestamp", *MEASURES, "station_type")


@query(
    "F10_last_days_of_landed_records",
    f"SELECT station, {TS} FROM readings WHERE {TS} >= TIMESTAMP '{AS_OF}' - INTERVAL 5 DAYS",
    ("readings",),
)
def last_days(spark, folder):
    times = landed(spark, folder).select("station", parse_timestamp("heure_utc").alias("timestamp"))
    return since(times, AS_OF, 5)


@query(
    "O5_newest_landed_records",
    f"SELECT station, {TS} FROM readings ORDER BY {TS} DESC, station LIMIT 100",
    ("readings",),
)
def newest_landed(spark, folder):
    return newest(sources.project_api_records(landed(spark, folder), "station").select("station", "timestamp"), 100)


@query(
    "S9_city_weather",
    f"""SELECT {TS}, station, {r('temperature')}, {r('humidite')}, {r('pression')}, {r('vitesse_vent')}, {r('direction_vent')},
      'ciel ' || station AS description FROM readings""",
    ("readings",),
)
def city_weather(spark, folder):
    docs = adapters.readings(spark, folder).select(
        "timestamp",
        F.col("station").alias("name"),
        F.struct(F.col("temperature").alias("temp"), F.col("humidite").alias("humidity"), (F.col("pression") / 100).alias("pressure")).alias("main"),
        F.struct(F.col("vitesse_vent").alias("speed"), F.col("direction_vent").alias("deg")).alias("wind"),
        F.array(F.struct(F.concat(F.lit("ciel "), F.col("station")).alias("description"))).alias("weather"),
    )
    return sources.project_city_weather(docs, F.col("timestamp")).drop("precipitation")


@query("K1_S1_csv_and_back", f"SELECT {TS}, station, {SHOWN} FROM readings", ("readings",))
def csv_and_back(spark, folder):
    path = _folder(spark, "csv")
    sinks.write_csv(adapters.readings(spark, folder).select(*READINGS.names), path)
    return sources.read_readings_csv(spark, path)


@query(
    "K5_K9_stored_by_day",
    f"""SELECT station, {TS}, CAST({TS} AS DATE) AS jour, {r('min(temperature)', 'temperature')}
    FROM readings GROUP BY station, {TS}""",
    ("readings",),
)
def stored_by_day(spark, folder):
    """Three overlapping batches into a table by day; each key is stored once."""
    path = _folder(spark, "readings")
    rows = adapters.readings(spark, folder).select("timestamp", "station", "temperature")
    for low, high in ((1, 12), (8, 20), (15, 31)):
        sinks.store_new(rows.filter(F.dayofmonth("timestamp").between(low, high)), path, order=("temperature",))
    return spark.read.parquet(path).select("station", "timestamp", "jour", "temperature")


@query(
    "E3_Q11_metrics_kept_up_to_date",
    f"""SELECT station, {TS}, {r('temp_moy_7j')}, {r('temp_moy_30j')}, {r('temp_volatilite_7j')}, {r('temp_volatilite_30j')},
      {r('temp_tendance_24h')}, indice_confort FROM rolled""",
    ("rolled",),
)
def metrics_kept_up_to_date(spark, folder):
    """The readings in two batches, late ones second: the stored metrics equal those of all readings at once."""
    table, results = _folder(spark, "readings"), _folder(spark, "metrics")
    rows = adapters.readings(spark, folder)
    late = F.pmod(F.xxhash64("station", "timestamp"), F.lit(500)) == 0
    for batch in (rows.filter(~late), rows.filter(late)):
        stored.store_and_update(batch, table, results)
    return spark.read.parquet(results).select(
        "station", "timestamp", "temp_moy_7j", "temp_moy_30j", "temp_volatilite_7j", "temp_volatilite_30j", "temp_tendance_24h", "indice_confort"
    )
