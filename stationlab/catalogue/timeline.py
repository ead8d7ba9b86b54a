"""Windows, anomalies, derived columns and the batch job."""

from pyspark.sql import functions as F

from stationlab import adapters
from stationlab.catalogue.registry import query, r
from stationlab.functions import comfort_class, felt_temperature_sql, pressure_to_pa, rain_risk
from stationlab.functions.sql import register_sql_functions
from stationlab.operators import anomalies, metrics, windows
from stationlab.operators.filters import drop_incomplete
from stationlab.operators.quantiles import box_stats
from stationlab.operators.summaries import anomaly_counts, daily_summary


def clean(spark, folder):
    return drop_incomplete(adapters.readings(spark, folder))


ROLL = ("temp_moy_7j", "temp_moy_30j", "temp_volatilite_7j", "temp_volatilite_30j", "temp_tendance_24h")
ROLLED_SQL = ", ".join(r(c) for c in ROLL)


@query("W1_W5_rolling_rows", f'SELECT station, "timestamp", {ROLLED_SQL} FROM rolled', ("rolled",))
def rolling_rows(spark, folder):
    return windows.rolling_metrics(clean(spark, folder)).select("station", "timestamp", *ROLL)


_TIME = """
SELECT station, "timestamp",
  {m7}, {m30}, {v7}, {v30}, {trend}
FROM (SELECT station, "timestamp",
  avg(temperature) OVER w7 AS m7, avg(temperature) OVER w30 AS m30,
  stddev_samp(temperature) OVER w7 AS v7, stddev_samp(temperature) OVER w30 AS v30,
  temperature - last_value(temperature) OVER w1 AS tr
  FROM clean WINDOW
    w7 AS (PARTITION BY station ORDER BY "timestamp"
      RANGE BETWEEN INTERVAL 7 DAYS PRECEDING AND CURRENT ROW),
    w30 AS (PARTITION BY station ORDER BY "timestamp"
      RANGE BETWEEN INTERVAL 30 DAYS PRECEDING AND CURRENT ROW),
    w1 AS (PARTITION BY station ORDER BY "timestamp"
      RANGE BETWEEN INTERVAL 30 HOURS PRECEDING AND INTERVAL 24 HOURS PRECEDING))
""".format(
    m7=r("m7", "temp_moy_7j"),
    m30=r("m30", "temp_moy_30j"),
    v7=r("v7", "temp_volatilite_7j"),
    v30=r("v30", "temp_volatilite_30j"),
    trend=r("tr", "temp_tendance_24h"),
)


@query("W7_W9_rolling_time", _TIME, ("clean",))
def rolling_time(spark, folder):
    return windows.rolling_metrics(clean(spark, folder), "time").select("station", "timestamp", *ROLL)


# Some readings are replaced by sensor faults; frames without them must not know of them.
_FAULTY = """
SELECT station, "timestamp", {mean}, {deviation}
FROM (SELECT station, "timestamp", avg(t) OVER w AS m, stddev_samp(t) OVER w AS v
  FROM (SELECT *, CASE WHEN pression BETWEEN 99000 AND 99004 THEN 1e17
      WHEN pression BETWEEN 102000 AND 102004 THEN 1e9 ELSE temperature END AS t FROM clean)
  WINDOW w AS (PARTITION BY station ORDER BY "timestamp" {frame}))
WHERE m < 100000
"""


def _faulty_sql(frame: str) -> str:
    return _FAULTY.format(mean=r("m", "temp_moy_7j"), deviation=r("v", "temp_volatilite_7j"), frame=frame)


def _faulty(spark, folder, mode):
    pressure = F.col("pression")
    fault = F.when(pressure.between(99000, 99004), 1e17).when(pressure.between(102000, 102004), 1e9)
    spoilt = clean(spark, folder).withColumn("temperature", F.coalesce(fault, "temperature"))
    rolled = windows.rolling_metrics(spoilt, mode).filter("temp_moy_7j < 100000")
    return rolled.select("station", "timestamp", "temp_moy_7j", "temp_volatilite_7j")


@query("W1_W3_rolling_rows_faults", _faulty_sql("ROWS BETWEEN 168 PRECEDING AND CURRENT ROW"), ("clean",))
def rolling_rows_faults(spark, folder):
    return _faulty(spark, folder, "rows")


@query(
    "W7_rolling_time_faults",
    _faulty_sql("RANGE BETWEEN INTERVAL 7 DAYS PRECEDING AND CURRENT ROW"),
    ("clean",),
)
def rolling_time_faults(spark, folder):
    return _faulty(spark, folder, "time")


@query(
    "W8_variation_volatility",
    f"""SELECT station, "timestamp", {r('variation')},
      {r('stddev_samp(variation) OVER (PARTITION BY station ORDER BY "timestamp" ROWS BETWEEN 168 PRECEDING AND CURRENT ROW)', 'variation_volatilite')}
    FROM (SELECT *, temperature - lag(temperature)
            OVER (PARTITION BY station ORDER BY "timestamp") AS variation FROM clean)""",
    ("clean",),
)
def variation_volatility(spark, folder):
    return windows.variation_volatility(clean(spark, folder)).select(
        "station", "timestamp", "variation", "variation_volatilite"
    )


ENRICHED = ("indice_confort", "risque_precipitation", "temperature_ressentie")


@query(
    "P3_X1_X3_X4_enrich",
    f"""SELECT station, "timestamp", {r('temperature')}, indice_confort, risque_precipitation,
      {r('temperature_ressentie')} FROM enriched""",
    ("enriched",),
)
def enrich(spark, folder):
    return metrics.enrich(clean(spark, folder)).select("station", "timestamp", "temperature", *ENRICHED)


_CLASS_SQL = """CASE WHEN temperature IS NULL OR humidite IS NULL THEN 'inconnu'
    WHEN temperature BETWEEN 18 AND 24 AND humidite BETWEEN 40 AND 60 THEN 'optimal'
    WHEN temperature > 30 OR (temperature > 25 AND humidite > 70) THEN 'trop_chaud'
    WHEN temperature < 10 THEN 'froid' WHEN humidite > 80 THEN 'humide'
    WHEN humidite < 30 THEN 'sec' ELSE 'modere' END AS classe_confort"""
_FELT_SQL = """CASE WHEN temperature IS NULL OR humidite IS NULL OR vitesse_vent IS NULL THEN temperature
    WHEN temperature > 25 THEN temperature + (humidite - 50) * 0.1
    WHEN temperature < 10 THEN temperature - vitesse_vent * 0.5 ELSE temperature END"""


@query(
    "X2_X5_classes",
    f"""SELECT station, "timestamp", {_CLASS_SQL}, {r(_FELT_SQL, 'ressentie')} FROM readings""",
    ("readings",),
)
def classes(spark, folder):
    return adapters.readings(spark, folder).select(
        "station",
        "timestamp",
        comfort_class().alias("classe_confort"),
        felt_temperature_sql().alias("ressentie"),
    )


@query(
    "G1_sql_functions",
    f"""SELECT station, "timestamp", {_CLASS_SQL}, {r(_FELT_SQL, 'ressentie')} FROM readings""",
    ("readings",),
)
def sql_functions(spark, folder):
    register_sql_functions(spark)
    adapters.readings(spark, folder).createOrReplaceTempView("mesures_meteo")
    return spark.sql(
        """SELECT station, `timestamp`,
             classifer_confort(temperature, humidite) AS classe_confort,
             temperature_ressentie(temperature, humidite, vitesse_vent) AS ressentie
           FROM mesures_meteo"""
    )


@query(
    "X27_rain_risk_hpa",
    """SELECT station, "timestamp",
      CASE WHEN humidite > 80 AND pression < 101000 THEN 'eleve' WHEN humidite > 70 THEN 'modere'
           WHEN humidite > 60 THEN 'faible' ELSE 'tres_faible' END AS risque_precipitation
    FROM readings""",
    ("readings",),
)
def rain_risk_hpa(spark, folder):
    # Pressure sent in hPa and normalised back; whole pascals survive the trip.
    sent = adapters.readings(spark, folder).withColumn("pression", F.col("pression") / 100)
    pascals = F.round(pressure_to_pa("pression", "hPa"), 6)
    return sent.select(
        "station", "timestamp", rain_risk("humidite", pascals).alias("risque_precipitation")
    )


LIMITS = tuple(anomalies.THRESHOLDS)


@query("A12_thresholds", f"SELECT {', '.join(r(c) for c in LIMITS)} FROM limits", ("limits",))
def thresholds(spark, folder):
    return anomalies.thresholds(clean(spark, folder), exact=True)


@query(
    "A12_thresholds_by_station",
    """SELECT station, {}, {}, {}, {}, {} FROM clean GROUP BY station""".format(
        *[r(f"quantile_disc({m}, {p})", name) for name, (m, p) in anomalies.THRESHOLDS.items()]
    ),
    ("clean",),
)
def thresholds_by_station(spark, folder):
    return anomalies.thresholds(clean(spark, folder), by="station", exact=True)


RANK_ERROR = 0.01
"""What a sketch's threshold may be off, as a share of the rows."""


@query(
    "A12_thresholds_sketch",
    " UNION ALL ".join(
        f"""SELECT '{name}' AS seuil, count({m}) AS valeurs,
          avg(CASE WHEN {m} < {name} THEN 1.0 ELSE 0.0 END) <= {p} + {RANK_ERROR} AS pas_trop_haut,
          avg(CASE WHEN {m} <= {name} THEN 1.0 ELSE 0.0 END) >= {p} - {RANK_ERROR} AS pas_trop_bas
        FROM clean, (SELECT approx_quantile({m}, {p}) AS {name} FROM clean) WHERE {m} IS NOT NULL"""
        for name, (m, p) in anomalies.THRESHOLDS.items()
    ),
    ("clean",),
)
def thresholds_sketch(spark, folder):
    """Each engine's own sketch, held against all rows: are there too many below it, or too few up to it?"""
    rows = clean(spark, folder)
    return anomalies.rank_errors(rows, anomalies.thresholds(rows), RANK_ERROR)


FLAGS = ("anomalie_temperature", "anomalie_vent", "anomalie_pression")
SCORES = ("score_anomalie_temp", "score_anomalie_vent", "score_anomalie_pression")


@query(
    "J4_X6_X7_anomalies",
    f"""SELECT station, "timestamp", {', '.join(FLAGS)}, {', '.join(r(s) for s in SCORES)}
    FROM flagged""",
    ("flagged",),
)
def detect(spark, folder):
    return anomalies.detect_anomalies(clean(spark, folder), exact=True).select(
        "station", "timestamp", *FLAGS, *SCORES
    )


@query(
    "A13_anomaly_counts",
    """SELECT CAST(count(*) FILTER (anomalie_temperature) AS BIGINT) AS nb_anomalies_temp,
      CAST(count(*) FILTER (anomalie_vent) AS BIGINT) AS nb_anomalies_vent,
      CAST(count(*) FILTER (anomalie_pression) AS BIGINT) AS nb_anomalies_pression FROM flagged""",
    ("flagged",),
)
def counts(spark, folder):
    return anomaly_counts(anomalies.detect_anomalies(clean(spark, folder), exact=True))


SUMMARY_SQL = f"""SELECT station, strftime("timestamp", '%Y-%m-%d') AS date,
  count(*) AS nb_mesures,
  {r('avg(temperature)', 'temp_moyenne')}, {r('min(temperature)', 'temp_min')},
  {r('max(temperature)', 'temp_max')}, {r('stddev_samp(temperature)', 'temp_volatilite')},
  {r('avg(humidite)', 'humidite_moyenne')}, {r('min(humidite)', 'humidite_min')},
  {r('max(humidite)', 'humidite_max')}, {r('avg(pression)', 'pression_moyenne')},
  {r('min(pression)', 'pression_min')}, {r('max(pression)', 'pression_max')},
  {r('sum(precipitation)', 'precipitation_totale')}, {r('avg(vitesse_vent)', 'vent_moyen')},
  {r('max(vitesse_vent)', 'vent_max')},
  count(*) FILTER (anomalie_temperature) AS nb_anomalies_temp,
  count(*) FILTER (anomalie_vent) AS nb_anomalies_vent,
  count(*) FILTER (anomalie_pression) AS nb_anomalies_pression
FROM flagged GROUP BY ALL"""


@query("A1_X8_daily_summary", SUMMARY_SQL, ("flagged",))
def summary(spark, folder):
    return daily_summary(anomalies.detect_anomalies(clean(spark, folder), exact=True))


@query(
    "A17_box_stats",
    """SELECT station_name, {}, {}, {}, {}, {} FROM readings GROUP BY station_name""".format(
        *[
            r(f"quantile_cont(temperature, {p})", name)
            for name, p in (("minimum", 0.0), ("q1", 0.25), ("mediane", 0.5), ("q3", 0.75), ("maximum", 1.0))
        ]
    ),
    ("readings",),
)
def box(spark, folder):
    return box_stats(adapters.readings(spark, folder))


BATCH_DOUBLES = (
    "temperature", "humidite", "pression", "vitesse_vent", "direction_vent", "precipitation",
    *ROLL, "temperature_ressentie", *SCORES,
)


@query(
    "E1_batch_metrics",
    f"""SELECT station, station_name, "timestamp", indice_confort, risque_precipitation,
      {', '.join(FLAGS)}, {', '.join(r(c) for c in BATCH_DOUBLES)} FROM flagged""",
    ("flagged",),
)
def batch(spark, folder):
    return metrics.compute_metrics(adapters.readings(spark, folder), exact=True)


@query(
    "P5_preview",
    f"""SELECT station, {r('temperature')}, {r('temp_moy_7j')}, indice_confort
    FROM rolled ORDER BY "timestamp", station LIMIT 5""",
    ("rolled",),
)
def preview(spark, folder):
    return (
        metrics.enrich(windows.rolling_metrics(clean(spark, folder)))
        .orderBy("timestamp", "station")
        .select("station", "temperature", "temp_moy_7j", "indice_confort")
        .limit(5)
    )
