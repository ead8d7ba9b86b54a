"""Summaries, question queries and views."""

from pyspark.sql import functions as F

from stationlab import adapters
from stationlab.catalogue.registry import ALERTS_AS_OF, AS_OF, query, r
from stationlab.functions import rain_to_show
from stationlab.operators import correlations, joins, metrics, summaries, windows
from stationlab.operators.filters import drop_incomplete
from stationlab.plans import questions, views

NOW = f"TIMESTAMP '{AS_OF}'"
ALERTS_NOW = f"TIMESTAMP '{ALERTS_AS_OF}'"
TS = '"timestamp"'


def readings(spark, folder):
    return adapters.readings(spark, folder)


def simple(name, oracle, build, needs=("readings",)):
    """Register a query that only needs the readings."""
    query(name, oracle, needs)(lambda spark, folder: build(readings(spark, folder)))


MONTHLY = f"""SELECT station, CAST(date_trunc('month', {TS}) AS TIMESTAMP) AS mois,
  count(*) AS nb_mesures,
  {r('avg(temperature)', 'temp_moyenne')}, {r('min(temperature)', 'temp_min')},
  {r('max(temperature)', 'temp_max')}, {r('stddev_samp(temperature)', 'temp_volatilite')},
  {r('avg(humidite)', 'humidite_moyenne')}, {r('sum(precipitation)', 'precipitation_totale')},
  {r('avg(vitesse_vent)', 'vent_moyen')}, {r('max(vitesse_vent)', 'vent_max')}
FROM readings WHERE {TS} >= {NOW} - INTERVAL 12 MONTHS GROUP BY ALL"""
simple("A2_X9_Q23_monthly_stats", MONTHLY, lambda df: views.monthly_view(df, AS_OF))


def extremes_sql(shown: str) -> str:
    return f"""SELECT CAST({TS} AS DATE) AS date, {shown}
  {r('min(temperature)', 'temp_min')}, {r('max(temperature)', 'temp_max')},
  {r('avg(temperature)', 'temp_moyenne')}
FROM readings WHERE {TS} >= {NOW} - INTERVAL 30 DAYS GROUP BY ALL"""


simple(
    "A3_X10_Q7_daily_extremes",
    extremes_sql("station_name,"),
    lambda df: summaries.daily_extremes(df, AS_OF),
)
simple(
    "A3_daily_extremes_overall",
    extremes_sql(""),
    lambda df: summaries.daily_extremes(df, AS_OF, by_station=False),
)


def overview_sql(days: int, shown: str = "station_name,") -> str:
    return f"""SELECT CAST({TS} AS DATE) AS date, {shown}
  {r('avg(temperature)', 'temp_moy')}, {r('max(vitesse_vent)', 'vent_max')},
  {r('sum(precipitation)', 'pluie_totale')}
FROM readings WHERE {TS} >= {NOW} - INTERVAL {days} DAYS GROUP BY ALL"""


simple(
    "A4a_Q14_this_week", overview_sql(7), lambda df: summaries.daily_overview(df, AS_OF, 7)
)
simple(
    "A4a_this_week_overall",
    overview_sql(7, ""),
    lambda df: summaries.daily_overview(df, AS_OF, 7, by_station=False),
)
simple(
    "A4b_Q15_this_month", overview_sql(30), lambda df: summaries.daily_overview(df, AS_OF, 30)
)
simple(
    "A5_F6_X24_Q13_yesterday",
    f"""SELECT CAST({TS} AS DATE) AS date, station_name,
  {r('avg(temperature)', 'temp_moyenne')}, {r('max(temperature)', 'temp_max')},
  {r('min(temperature)', 'temp_min')}, {r('avg(humidite)', 'humidite_moyenne')},
  {r('sum(precipitation)', 'pluie_totale')}
FROM readings WHERE CAST({TS} AS DATE) = CAST({NOW} AS DATE) - 1 GROUP BY ALL""",
    lambda df: summaries.yesterday_by_station(df, AS_OF),
)


def compare_sql(means: dict[str, str], period: str, count: str = "") -> str:
    shown = ", ".join(r(f"avg({m})", name) for m, name in means.items())
    return f"""SELECT station_name, {shown} {count}
FROM readings WHERE {TS} >= {NOW} - INTERVAL {period} GROUP BY station_name, station"""


THREE = {"temperature": "temp_moyenne", "humidite": "humidite_moyenne", "vitesse_vent": "vent_moyen"}
simple(
    "A6_Q4_station_comparison",
    compare_sql(THREE, "24 HOURS", ", count(*) AS nb_mesures"),
    lambda df: questions.station_comparison(df, AS_OF),
)
simple("A7_Q17_comparison", compare_sql(THREE, "7 DAYS"), lambda df: questions.comparison(df, AS_OF))
simple(
    "A8_Q20_quick_compare",
    compare_sql(
        {"temperature": "temp_moy", "humidite": "hum_moy"}, "24 HOURS", ", count(*) AS nb_mesures"
    ),
    lambda df: questions.quick_compare(df, AS_OF),
)
for measure, ascending in (
    ("temperature", False),
    ("temperature", True),
    ("humidite", False),
    ("vitesse_vent", False),
):
    direction = "asc" if ascending else "desc"
    simple(
        f"A9_F11_Q5_ranking_{measure}_{direction}",
        f"""SELECT station_name, {r(f'avg({measure})', 'valeur_moyenne')},
  {r(f'max({measure})', 'valeur_max')}, {r(f'min({measure})', 'valeur_min')}
FROM readings WHERE {TS} >= {NOW} - INTERVAL 7 DAYS GROUP BY station_name, station""",
        lambda df, m=measure, up=ascending: summaries.station_ranking(df, AS_OF, m, up),
    )
simple(
    "A10_X17_describe_by_station",
    f"""SELECT station_name, {r('round(avg(temperature), 2)', 'mean')},
  {r('round(min(temperature), 2)', 'min')}, {r('round(max(temperature), 2)', 'max')},
  {r('round(stddev_samp(temperature), 2)', 'std')}
FROM readings GROUP BY station_name""",
    summaries.describe_by_station,
)
simple(
    "A11_result_stats",
    f"""SELECT {r('avg(temperature)', 'temp_moyenne')}, {r('min(temperature)', 'temp_min')},
  {r('max(temperature)', 'temp_max')},
  {r('max(temperature) - min(temperature)', 'amplitude')},
  {r('avg(humidite)', 'humidite_moyenne')} FROM readings""",
    summaries.result_stats,
)
simple(
    "A11_X17_display_stats",
    f"""SELECT {r('round(avg(temperature), 1)', 'temp_moyenne')},
  {r('round(max(temperature) - min(temperature), 1)', 'amplitude')},
  {r('round(avg(humidite), 0)', 'humidite_moyenne')} FROM readings""",
    summaries.display_stats,
)
simple(
    "A14_station_count",
    "SELECT count(DISTINCT station) AS nb_stations FROM readings",
    summaries.station_count,
)
COLUMNS = (
    "station", "station_name", "timestamp", "temperature", "humidite", "pression",
    "vitesse_vent", "direction_vent", "precipitation",
)
simple(
    "A15_completeness",
    " UNION ALL ".join(
        f"SELECT '{c}' AS colonne, count(\"{c}\") AS non_nulls, count(*) AS total FROM readings"
        for c in COLUMNS
    ),
    summaries.completeness,
)
simple(
    "A16_covered_period",
    f"SELECT min({TS}) AS debut, max({TS}) AS fin FROM readings",
    summaries.covered_period,
)
simple("A18_row_count", "SELECT count(*) AS nb_lignes FROM readings", summaries.row_count)
simple(
    "A20_seasonal_profile",
    f"""SELECT station, CAST(month({TS}) AS INT) AS mois, CAST(hour({TS}) AS INT) AS heure,
  {r('avg(temperature)', 'temp_moyenne')}, count(*) AS nb_mesures FROM readings GROUP BY ALL""",
    summaries.seasonal_profile,
)
simple(
    "A21_warmest_year",
    f"""SELECT annee, {r('m', 'temp_moyenne')} FROM (
  SELECT CAST(year({TS}) AS INT) AS annee, avg(temperature) AS m FROM readings GROUP BY 1
  ORDER BY m DESC, annee LIMIT 1)""",
    summaries.warmest_year,
)
simple(
    "A22_baseline_prediction",
    f"""SELECT r.station, r.{TS}, {r('r.temperature', 'temperature')}, b.heure, {r('b.p', 'prediction')}
FROM readings r JOIN (SELECT station, CAST(hour({TS}) AS INT) AS heure, avg(temperature) AS p
  FROM readings GROUP BY ALL) b ON r.station = b.station AND hour(r.{TS}) = b.heure""",
    lambda df: joins.baseline_prediction(df).select(
        "station", "timestamp", "temperature", "heure", "prediction"
    ),
)
for days, label in ((1, "day"), (7, "week")):
    simple(
        f"J6_{label}_over_{label}",
        f"""SELECT station, {r('a', 'temp_moyenne')}, {r('b', 'temp_moyenne_avant')},
  na AS nb_mesures, nb AS nb_mesures_avant, {r('a - b', 'ecart')}
FROM (SELECT station,
  avg(temperature) FILTER ({TS} >= {NOW} - INTERVAL {days} DAYS) AS a,
  avg(temperature) FILTER ({TS} < {NOW} - INTERVAL {days} DAYS) AS b,
  count(*) FILTER ({TS} >= {NOW} - INTERVAL {days} DAYS) AS na,
  count(*) FILTER ({TS} < {NOW} - INTERVAL {days} DAYS) AS nb
  FROM readings WHERE {TS} >= {NOW} - INTERVAL {2 * days} DAYS AND {TS} < {NOW} GROUP BY station)""",
        lambda df, d=days: summaries.period_over_period(df, AS_OF, d),
    )


@query(
    "A19_weather_activity_correlation",
    f"""SELECT zone, 'temperature' AS variable_meteo, 'activite' AS variable_urbaine,
  'hour' AS periode_analyse, {r('c', 'valeur_correlation')}, n AS nb_periodes,
  {r('CASE WHEN n > 2 AND abs(c) < 1 THEN c * sqrt((n - 2) / (1 - c * c)) END', 'significativite')}
FROM (SELECT w.station AS zone, corr(w.t, a.k) AS c, count(*) AS n
  FROM (SELECT station, date_trunc('hour', {TS}) AS heure, avg(temperature) AS t
        FROM readings GROUP BY ALL) w
  JOIN (SELECT event_type AS station, date_trunc('hour', ts) AS heure, CAST(count(*) AS DOUBLE) AS k
        FROM events GROUP BY ALL) a USING (station, heure)
  WHERE w.t IS NOT NULL GROUP BY w.station)""",
    ("readings",),
)
def correlation(spark, folder):
    activity = adapters.table(spark, folder, "events").select(
        F.col("event_type").alias("station"), F.col("ts").alias("timestamp")
    )
    return joins.weather_activity_correlation(readings(spark, folder), activity)


def correlations_sql(period: str) -> str:
    return f"""SELECT p AS "timestamp", 'pearson' AS type_correlation, {r('c', 'valeur_correlation')},
  'temperature' AS variable_meteo, genre AS variable_urbaine, zone, '{period}' AS periode_analyse,
  {r('CASE WHEN n > 2 AND 1 - c * c > 1e-9 THEN c * sqrt((n - 2) / (1 - c * c)) END', 'significativite')}
FROM (SELECT p, zone, genre, count(*) AS n,
    CASE WHEN var_pop(x) > 0 AND var_pop(y) > 0 THEN corr(x, y) END AS c
  FROM (SELECT CAST(date_trunc('{period}', w.h) AS TIMESTAMP) AS p, w.zone, k.genre, w.x, CAST(coalesce(u.y, 0) AS DOUBLE) AS y
    FROM (SELECT station AS zone, date_trunc('hour', {TS}) AS h, avg(temperature) AS x
          FROM readings WHERE temperature IS NOT NULL GROUP BY ALL) w
    JOIN (SELECT DISTINCT event_type AS zone, 'genre_' || (user_id % 3) AS genre, date_trunc('day', ts) AS d FROM events) k
      ON k.zone = w.zone AND k.d = date_trunc('day', w.h)
    LEFT JOIN (SELECT event_type AS zone, 'genre_' || (user_id % 3) AS genre, date_trunc('hour', ts) AS h, count(*) AS y
          FROM events GROUP BY ALL) u ON u.zone = w.zone AND u.genre = k.genre AND u.h = w.h)
  GROUP BY ALL)"""


def daily_comoments(spark, folder):
    events = adapters.table(spark, folder, "events")
    kind = F.concat(F.lit("genre_"), (F.col("user_id") % 3).cast("string")).alias("type_evenement")
    urban = events.select(F.col("event_type").alias("station"), kind, F.col("ts").alias("debut"))
    return correlations.comoments(readings(spark, folder), urban)


@query("A19_correlations_per_day", correlations_sql("day"), ("readings",))
def correlations_per_day(spark, folder):
    return correlations.correlations(daily_comoments(spark, folder))


@query("A19_correlations_per_month", correlations_sql("month"), ("readings",))
def correlations_per_month(spark, folder):
    return correlations.correlations(correlations.merged(daily_comoments(spark, folder), "month"))


@query(
    "A14_stations_per_day",
    f"SELECT CAST({TS} AS DATE) AS jour, count(DISTINCT station) AS nb_distincts FROM readings GROUP BY ALL",
    ("readings",),
)
def stations_per_day(spark, folder):
    """From sketches; with few distinct values an estimate is the number itself."""
    return summaries.distinct_count(summaries.daily_sketches(readings(spark, folder)), ("jour",))


# Question queries -----------------------------------------------------------

simple(
    "Q1_J2_F8_current",
    f"""SELECT station_name, {r('temperature')}, {r('humidite')}, {r('vitesse_vent')}, {TS}
FROM readings WHERE {TS} = (SELECT max({TS}) FROM readings)""",
    questions.current,
)
simple(
    "Q1_O1_current_single",
    f"""SELECT {TS}, {r('temperature')}, {r('humidite')}, {r('vitesse_vent')}, {r('precipitation')}
FROM readings ORDER BY {TS} DESC, station LIMIT 1""",
    questions.current_single,
)
for label, station in (("Q2_F5_station_a", "view"), ("Q3_F5_station_b", "purchase")):
    simple(
        label,
        f"""SELECT {TS}, {r('temperature')}, {r('humidite')}, {r('vitesse_vent')}
FROM readings WHERE station = '{station}' ORDER BY {TS} DESC LIMIT 24""",
        lambda df, s=station: questions.one_station(df, s),
    )
simple(
    "Q6_temperature_period",
    f"""SELECT {TS}, station_name, {r('temperature')}, {r('humidite')}
FROM readings WHERE {TS} >= {NOW} - INTERVAL 7 DAYS ORDER BY {TS} DESC, station LIMIT 100""",
    lambda df: questions.temperature_period(df, AS_OF, 7),
)
simple(
    "Q8_F4_precipitation",
    f"""SELECT {TS}, station_name, {r('precipitation')}, {r('humidite')}, {r('temperature')}
FROM readings WHERE precipitation > 0 AND {TS} >= {NOW} - INTERVAL 7 DAYS""",
    lambda df: questions.precipitation(df, AS_OF),
)
for limit in (15, 20):
    simple(
        f"Q9_F4_O2_strong_wind_{limit}",
        f"""SELECT {TS}, station_name, {r('vitesse_vent')}, {r('direction_vent')}, {r('temperature')}
FROM readings WHERE vitesse_vent > {limit} AND {TS} >= {NOW} - INTERVAL 7 DAYS""",
        lambda df, w=limit: questions.strong_wind(df, AS_OF, w),
    )
simple(
    "Q10_wind_direction",
    f"""SELECT {TS}, {r('direction_vent')}, {r('vitesse_vent')}
FROM readings WHERE {TS} >= {NOW} - INTERVAL 24 HOURS""",
    lambda df: questions.wind_direction(df, AS_OF),
)


def rolled_metrics(df):
    return metrics.enrich(windows.rolling_metrics(drop_incomplete(df)))


simple(
    "Q11_trends",
    f"""SELECT {TS}, {r('temp_moy_7j')}, {r('temp_volatilite_7j')}, indice_confort
FROM rolled WHERE {TS} >= {NOW} - INTERVAL 30 DAYS""",
    lambda df: questions.trends(rolled_metrics(df), AS_OF),
    ("rolled",),
)


@query(
    "Q12_F7b_alerts",
    f"SELECT type_alerte, niveau, debut, fin, zone FROM alerts WHERE fin >= {ALERTS_NOW}",
    ("alerts",),
)
def unexpired(spark, folder):
    return questions.alerts(adapters.alerts(spark, folder), ALERTS_AS_OF)


simple(
    "Q16_rain_outlook",
    f"""SELECT {TS}, station_name, {r('precipitation')}, {r('humidite')}, {r('temperature')}
FROM readings WHERE {TS} >= {NOW} - INTERVAL 24 HOURS""",
    lambda df: questions.rain_outlook(df, AS_OF),
)
simple(
    "Q18_O1_general",
    f"""SELECT {TS}, station_name, {r('temperature')}, {r('humidite')}, {r('vitesse_vent')},
  {r('precipitation')} FROM readings ORDER BY {TS} DESC, station LIMIT 50""",
    questions.general,
)
simple(
    "Q19_X25_dashboard_current",
    f"""SELECT station_name, {r('temperature')}, {r('humidite')}, {r('vitesse_vent')},
  {r('precipitation')}, {TS}, coalesce(precipitation > 0, false) AS pluie_affichee
FROM readings WHERE {TS} = (SELECT max({TS}) FROM readings)""",
    lambda df: questions.dashboard_current(df).withColumn("pluie_affichee", rain_to_show()),
)


# Views ----------------------------------------------------------------------

simple(
    "Q21_W6_latest_per_station",
    f"""SELECT DISTINCT ON (station) station, {TS}, {r('temperature')}, {r('humidite')},
  {r('pression')}, {r('vitesse_vent')}, {r('precipitation')}
FROM readings ORDER BY station, {TS} DESC""",
    views.latest_view,
)


@query(
    "Q22_F7a_O4_active_alerts",
    f"""SELECT type_alerte, niveau, zone, debut, fin FROM alerts
WHERE active AND (fin IS NULL OR fin > {ALERTS_NOW})""",
    ("alerts",),
)
def active(spark, folder):
    return views.active_alerts_view(adapters.alerts(spark, folder), ALERTS_AS_OF)


@query(
    "G2_views_from_sql",
    f"""SELECT l.station, l.{TS}, {r('l.temperature', 'temperature')}, m.nb_mesures,
  (SELECT count(*) FROM alerts WHERE active AND (fin IS NULL OR fin > {ALERTS_NOW})) AS nb_alertes
FROM (SELECT DISTINCT ON (station) * FROM readings ORDER BY station, {TS} DESC) l
JOIN (SELECT station, count(*) AS nb_mesures FROM readings
      WHERE {TS} >= {ALERTS_NOW} - INTERVAL 12 MONTHS GROUP BY station) m USING (station)""",
    ("readings", "alerts"),
)
def views_from_sql(spark, folder):
    views.register_views(readings(spark, folder), adapters.alerts(spark, folder), ALERTS_AS_OF)
    return spark.sql(
        """SELECT l.station, l.`timestamp`, l.temperature, m.nb_mesures,
             (SELECT count(*) FROM v_alertes_actives) AS nb_alertes
           FROM v_dernieres_mesures l
           JOIN (SELECT station, sum(nb_mesures) AS nb_mesures
                 FROM v_stats_mensuelles GROUP BY station) m ON l.station = m.station"""
    )


# One question end to end ------------------------------------------------------


@query(
    "E4_answer_ranking",
    f"""SELECT station_name, {r('avg(temperature)', 'valeur_moyenne')},
  {r('max(temperature)', 'valeur_max')}, {r('min(temperature)', 'valeur_min')}
FROM readings WHERE {TS} >= {NOW} - INTERVAL 7 DAYS GROUP BY station_name, station""",
    ("readings",),
)
def answer_ranking(spark, folder):
    tables = questions.Tables(readings(spark, folder))
    return questions.answer("Quelle est la station la plus chaude, quelle station a le plus ?", tables, AS_OF)


@query(
    "E4_answer_period_stats",
    f"""SELECT station_name, {r('round(avg(temperature), 2)', 'mean')},
  {r('round(min(temperature), 2)', 'min')}, {r('round(max(temperature), 2)', 'max')},
  {r('round(stddev_samp(temperature), 2)', 'std')}
FROM (SELECT * FROM readings WHERE {TS} >= {NOW} - INTERVAL 3 DAYS
      ORDER BY {TS} DESC, station LIMIT 100) GROUP BY station_name""",
    ("readings",),
)
def answer_stats(spark, folder):
    tables = questions.Tables(readings(spark, folder))
    return questions.answer_stats(questions.answer("Température des 3 derniers jours", tables, AS_OF))
