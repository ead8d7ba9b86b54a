import math

import pytest
from pyspark.sql import functions as F

from stationlab import functions as fn
from stationlab.functions.sql import register_sql_functions


def table(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def column(df, c):
    return [r[0] for r in df.select(c).collect()]


COMFORT = [
    # temperature, humidity, index, class
    (18.0, 40.0, "optimal", "optimal"),
    (24.0, 60.0, "optimal", "optimal"),
    (24.1, 60.0, "modere", "modere"),
    (18.0, 39.9, "modere", "modere"),
    (30.0, 50.0, "modere", "modere"),
    (30.1, 50.0, "trop_chaud", "trop_chaud"),
    (25.0, 71.0, "modere", "modere"),
    (25.1, 70.0, "modere", "modere"),
    (25.1, 70.1, "chaud_humide", "trop_chaud"),
    (4.9, 50.0, "tres_froid", "froid"),
    (5.0, 50.0, "froid", "froid"),
    (9.9, 90.0, "froid", "froid"),
    (10.0, 80.0, "modere", "modere"),
    (10.0, 80.1, "tres_humide", "humide"),
    (20.0, 29.9, "sec", "sec"),
    (20.0, 30.0, "modere", "modere"),
    (20.0, None, "modere", "inconnu"),
    (31.0, None, "trop_chaud", "inconnu"),
    (None, 85.0, "tres_humide", "inconnu"),
    (None, None, "modere", "inconnu"),
]


def test_comfort_limits(spark):
    df = table(spark, "t double, h double, i string, c string", *COMFORT)
    got = df.select(fn.comfort_index("t", "h"), fn.comfort_class("t", "h"), "i", "c").collect()
    assert [(r[0], r[1]) for r in got] == [(r[2], r[3]) for r in got]


def test_rain_risk_limits(spark):
    df = table(
        spark,
        "h double, p double, e string",
        (81.0, 100999.0, "eleve"),
        (81.0, 101000.0, "modere"),
        (80.0, 100000.0, "modere"),
        (70.0, 100000.0, "faible"),
        (60.0, 100000.0, "tres_faible"),
        (81.0, None, "modere"),
        (None, 100000.0, "tres_faible"),
    )
    assert column(df, fn.rain_risk("h", "p")) == column(df, "e")


FELT = [
    # t, h, wind, index form, SQL form
    (5.0, 50.0, 10.0, 0.0, 0.0),
    (10.0, 50.0, 10.0, 10.0, 10.0),
    (25.0, 90.0, 10.0, 25.0, 25.0),
    (30.0, 70.0, 10.0, 32.0, 32.0),
    (5.0, 50.0, None, None, 5.0),
    (5.0, None, 10.0, 0.0, 5.0),
    (30.0, None, 1.0, None, 30.0),
    (None, 50.0, 1.0, None, None),
]


def test_felt_temperature(spark):
    df = table(spark, "t double, h double, w double, a double, b double", *FELT)
    assert column(df, fn.felt_temperature("t", "h", "w")) == column(df, "a")
    assert column(df, fn.felt_temperature_sql("t", "h", "w")) == column(df, "b")


def test_sql_functions_equal_column_functions(spark):
    register_sql_functions(spark)
    table(spark, "t double, h double, w double, a double, b double", *FELT).createOrReplaceTempView("felt")
    got = spark.sql("SELECT temperature_ressentie(t, h, w), b FROM felt").collect()
    assert [r[0] for r in got] == [r[1] for r in got]
    table(spark, "t double, h double, i string, c string", *COMFORT).createOrReplaceTempView("comfort")
    got = spark.sql("SELECT classifer_confort(t, h), c FROM comfort").collect()
    assert [r[0] for r in got] == [r[1] for r in got]


def test_scores(spark):
    df = table(
        spark,
        "x double, lo double, hi double",
        (-3.0, -2.0, 5.0),  # a negative threshold gives a negative score
        (1.0, 2.0, 5.0),
        (6.0, 2.0, 5.0),
        (3.0, 2.0, 5.0),
        (-1.0, 0.0, 5.0),  # a zero threshold gives no score
        (None, 2.0, 5.0),
    )
    x, lo, hi = F.col("x"), F.col("lo"), F.col("hi")
    assert column(df, fn.is_outside(x, lo, hi)) == [True, True, True, False, True, False]
    assert column(df, fn.score_outside(x, lo, hi)) == [-0.5, 0.5, 0.2, 0.0, None, 0.0]
    assert column(df, fn.is_above(x, hi)) == [False, False, True, False, False, False]
    assert column(df, fn.score_above(x, hi)) == [0.0, 0.0, 0.2, 0.0, 0.0, 0.0]


def test_conversions(spark):
    df = table(
        spark,
        "bad string, millis long, x double, body binary",
        ("2024-13-45", 1718031600000, math.nan, b'{"a": 1}'),
    )
    row = df.select(
        fn.parse_timestamp("bad").alias("bad"),
        fn.parse_timestamp(F.lit("2024-06-10T15:00:00Z")).cast("string").alias("good"),
        fn.from_epoch_millis("millis").cast("string").alias("at"),
        fn.nan_to_null("x").alias("x"),
        fn.decode_bytes("body").alias("body"),
        fn.payload_preview(F.repeat(F.lit("é"), 150)).alias("preview"),
        fn.or_default(F.lit(None)).alias("unknown"),
        fn.has_entity(F.array(F.lit("toulouse"), F.lit("test")), "test").alias("entity"),
        fn.has_entity(F.lit(None).cast("array<string>"), "test").alias("no_entity"),
        fn.pressure_to_pa(F.lit(1013.0), "hPa").alias("pa"),
        fn.to_json_message(F.lit(None).cast("int").alias("a"), F.lit(2).alias("b")).alias("json"),
        fn.json_field(F.lit("not json"), "$.k", "int").alias("k"),
        fn.has_any_term(F.lit("Alerte CANICULE, ce soir"), ["Canicule"]).alias("term"),
        fn.has_any_term(F.lit("canicules"), ["canicule"]).alias("no_term"),
    ).first()
    assert row["bad"] is None and row["good"] == "2024-06-10 15:00:00"
    assert row["at"] == "2024-06-10 15:00:00"
    assert row["x"] is None and row["body"] == '{"a": 1}'
    assert row["preview"] == "é" * 100 and row["unknown"] == "Unknown"
    assert row["entity"] and not row["no_entity"]
    assert row["pa"] == 101300.0 and row["json"] == '{"b":2}' and row["k"] is None
    assert row["term"] and not row["no_term"]
    with pytest.raises(ValueError):
        fn.pressure_to_pa("x", "bar")


GOLDEN = {
    "température\rdans 10 jours": "temperature_period",
    "cette\u2028semaine": "this_week",
    "Quelle est la température maintenant ?": "current",
    "Compare les deux stations météo": "station_comparison",
    "Quelle station est la plus chaude ?": "station_ranking",
    "Température à Compans Caffarelli aujourd'hui": "current",
    "Données de Météopole cette semaine": "this_week",
    "Y a-t-il eu de la pluie récemment ?": "precipitation",
    "Vent fort dans les deux stations ?": "strong_wind",
    "Tendance de température hier": "trends",
    "Différence entre les stations": "station_comparison",
    "Température maximale ce mois": "this_month",
    "Montre-moi les températures des 7 derniers jours": "temperature_period",
    "Quand a-t-il plu cette semaine ?": "this_week",
    "Y a-t-il eu du vent fort récemment ?": "strong_wind",
    "Quelle est la tendance de température ?": "trends",
    "Compare les températures de cette semaine": "this_week",
    "Y a-t-il des alertes météo ?": "alerts",
    "Température maximale et minimale ce mois": "extremes",
    "Il fait combien aujourd'hui ?": "general",
    "Température des 7 derniers jours": "temperature_period",
    "Évolution de l'humidité cette semaine": "trends",
    "Tendance météo du mois": "trends",
    "Quand a-t-il plu récemment ?": "general",
    "Alertes météo en cours": "alerts",
    "Compare la température d'hier et aujourd'hui": "current",
    "Différence avec la semaine dernière": "general",
    "Année la plus chaude": "general",
}


def test_routing(spark):
    df = table(spark, "text string, route string", *GOLDEN.items())
    assert column(df, fn.classify_question("text")) == list(GOLDEN.values())
    assert [fn.route_of(q) for q in GOLDEN] == list(GOLDEN.values())


def test_first_number(spark):
    df = table(spark, "text string", ("les 12 derniers, ou 3",), ("aucun",), ("99999999999",), (None,))
    assert column(df, fn.first_number("text")) == [12, 7, 7, 7]
