import math
import random

import pytest
from pyspark.sql import functions as F

from stationlab.operators import (
    anomalies,
    correlations,
    dedup,
    filters,
    intervals,
    joins,
    ordering,
    quantiles,
    summaries,
)
from stationlab.plans import questions, views
from stationlab.schemas import CORRELATIONS

NOW = "2024-01-31 00:00:00"


def test_plan_pushes_filters_and_prunes_columns(spark):
    from stationlab import adapters

    df = adapters.readings(spark, "/root/testdata/sf0.001")
    recent = filters.since(df, NOW, 7).select("station", "vitesse_vent")
    plan = recent._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts,2024-01-24T00:00)" in plan
    assert "ReadSchema: struct<ts:timestamp_ntz,event_type:string,value:double>" in plan


def test_newest_is_planned_as_top_k(readings):
    df = readings(("2024-01-01 00:00:00", "a", 1.0))
    plan = ordering.newest(df, 10)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_day_before_is_a_half_open_range(readings):
    df = readings(
        ("2024-01-29 23:59:59", "a", 1.0),
        ("2024-01-30 00:00:00", "a", 2.0),
        ("2024-01-30 23:59:59", "a", 3.0),
        ("2024-01-31 00:00:00", "a", 4.0),
    )
    for as_of in (NOW, "2024-01-31 17:45:00"):
        assert {r["temperature"] for r in filters.on_day_before(df, as_of).collect()} == {2.0, 3.0}


def test_latest_time_and_ranges(readings):
    df = readings(
        ("2024-01-30 00:00:00", "a", 18.0, 40.0),
        ("2024-01-30 00:00:00", "b", 24.0, 60.0),
        ("2024-01-29 00:00:00", "a", 24.5, 61.0),
    )
    assert filters.at_latest_time(df).count() == 2
    assert filters.within(df, "temperature", 18, 24).count() == 2
    assert filters.in_period(df, "2024-01-29 00:00:00", "2024-01-30 00:00:00").count() == 3
    assert filters.since(df, "2024-01-31 00:00:00", 24, "hours").count() == 2
    assert filters.above(df, "temperature", 24).count() == 1
    assert filters.of_station(df, "a").count() == 2
    assert filters.drop_incomplete(readings((None, "a", 1.0), ("2024-01-01", None, 1.0))).isEmpty()


@pytest.fixture()
def alerts(spark):
    df = spark.createDataFrame(
        [
            (1, "2024-01-01", None, 2, True),
            (2, "2024-01-02", "2024-02-01", 3, True),
            (3, "2024-01-03", "2024-01-31", None, True),
            (4, "2024-01-04", "2024-02-01", 3, False),
            (5, "2024-01-05", "2024-02-01", 3, None),
        ],
        "id int, debut string, fin string, severite int, active boolean",
    )
    return df.withColumns({c: F.col(c).cast("timestamp") for c in ("debut", "fin")})


def test_alert_variants(alerts):
    assert {r["id"] for r in filters.active_alerts(alerts, NOW).collect()} == {1, 2}
    assert {r["id"] for r in filters.unexpired_alerts(alerts, NOW).collect()} == {2, 3, 4, 5}
    assert [r["id"] for r in ordering.by_severity(alerts).collect()] == [3, 5, 4, 2, 1]


def test_first_per_key_does_not_depend_on_partitions(spark):
    rows = [("t", "s", i % 7, float(i)) for i in range(200)]
    seen = set()
    for parts in (1, 3, 8):
        df = spark.createDataFrame(rows, "timestamp string, station string, a int, b double")
        out = dedup.first_per_key(df.repartition(parts), order=("b",)).collect()
        assert len(out) == 1
        seen.add(tuple(out[0]))
    assert seen == {("t", "s", 0, 0.0)}


def test_insert_or_ignore_is_idempotent(spark):
    schema = "timestamp string, station string, x int"
    target = spark.createDataFrame([("1", "a", 10)], schema)
    batch = spark.createDataFrame([("1", "a", 11), ("2", "a", 21), ("2", "a", 20)], schema)
    once = dedup.insert_or_ignore(batch, target)
    assert sorted(map(tuple, once.collect())) == [("1", "a", 10), ("2", "a", 20)]
    twice = dedup.insert_or_ignore(batch, once)
    assert sorted(map(tuple, twice.collect())) == sorted(map(tuple, once.collect()))


def test_append_unique(spark):
    schema = "timestamp string, station string, x int"
    target = spark.createDataFrame([("1", "a", 10)], schema)
    fresh = spark.createDataFrame([("2", "a", 1)], schema)
    assert dedup.append_unique(fresh, target).count() == 2
    for bad in ([("1", "a", 5)], [("3", "a", 1), ("3", "a", 2)]):
        with pytest.raises(dedup.DuplicateKeys):
            dedup.append_unique(spark.createDataFrame(bad, schema), target)


def test_union_fills_missing_columns(spark):
    a = spark.createDataFrame([(1, 2)], "x int, y int")
    b = spark.createDataFrame([(3,)], "x int")
    assert sorted(map(tuple, dedup.union_all([a, b]).collect()), key=str) == [(1, 2), (3, None)]


@pytest.mark.parametrize("n", [1, 2, 19, 20, 5000])
@pytest.mark.parametrize("distinct", [3, 10**6])
def test_exact_quantiles_against_sorting(spark, n, distinct):
    generator = random.Random(n + distinct)
    values = [float(generator.randrange(distinct)) for _ in range(n)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    shares = {"q5": 0.05, "q50": 0.5, "q95": 0.95, "q100": 1.0, "q0": 0.0}
    wanted = {k: ("x", p) for k, p in shares.items()}
    ordered = sorted(values)
    # A coarse sketch, so that the brackets really cut.
    disc = quantiles.exact_quantiles(df, wanted, accuracy=50).first()
    cont = quantiles.exact_quantiles(df, wanted, interpolate=True, accuracy=50).first()
    for name, p in shares.items():
        rank = max(-(-round(p * 100) * n // 100), 1)
        assert disc[name] == ordered[rank - 1]
        position = p * (n - 1)
        low = int(position)
        high = min(low + 1, n - 1)
        assert cont[name] == pytest.approx(ordered[low] + (ordered[high] - ordered[low]) * (position - low))


def test_quantiles_by_group_with_a_heavy_group(spark, monkeypatch):
    df = spark.range(30_000).select(
        F.when(F.col("id") % 3 < 2, "big").otherwise(F.concat(F.lit("g"), (F.col("id") % 30).cast("string"))).alias("g"),
        (F.col("id") * 7919 % 10007).cast("double").alias("x"),
    )
    expected = {
        r["g"]: r["p"] for r in df.groupBy("g").agg(F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY x)").alias("p")).collect()
    }
    for limit in (100_000, 1):  # broadcast, then ordinary join
        monkeypatch.setattr(quantiles, "MAX_BROADCAST_GROUPS", limit)
        out = quantiles.exact_quantiles(df, {"p": ("x", 0.95)}, by=("g",), accuracy=200)
        assert {r["g"]: r["p"] for r in out.collect()} == expected


def test_cells_stay_even_under_an_outlier(spark):
    """One value a million times the others' spread: the ranked cells still hold a small part of the values."""
    df = spark.range(40_000).select(F.when(F.col("id") == 7, 1e12).otherwise((F.col("id") * 7919 % 40009).cast("double")).alias("x"))
    row = quantiles.exact_quantiles(df, {"p5": ("x", 0.05), "top": ("x", 1.0), "low": ("x", 0.0)}, accuracy=10).first()
    values = sorted(r.x for r in df.collect())
    assert (row["p5"], row["top"], row["low"]) == (values[1999], 1e12, values[0])
    counted = df.groupBy(F.lit(0).alias("_j"), F.col("x").alias("_v")).agg(F.count("*").alias("_c"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r["count"] for r in quantiles.cells_of(counted, ["_j"]).groupBy("_cell").count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(sizes) == 40_000 and max(sizes) <= 2 * 40_000 / len(sizes)


def test_rank_errors_tell_a_wrong_threshold(spark):
    df = spark.range(1000).select(*[F.col("id").cast("double").alias(m) for m in ("temperature", "vitesse_vent", "pression")])
    good = {name: share * 1000 for name, (_, share) in anomalies.THRESHOLDS.items()}
    limits = spark.createDataFrame([{**good, "temp_p5": 90.0, "vent_p95": 900.0}])
    rows = {r.seuil: (r.pas_trop_haut, r.pas_trop_bas) for r in anomalies.rank_errors(df, limits, 0.01).collect()}
    assert rows.pop("temp_p5") == (False, True) and rows.pop("vent_p95") == (True, False)
    assert set(rows.values()) == {(True, True)}


def test_sketch_thresholds_keep_their_rank_error(spark):
    n, accuracy = 20_000, 1000
    df = spark.range(n).select(
        F.col("id").cast("double").alias("temperature"),
        F.col("id").cast("double").alias("vitesse_vent"),
        F.col("id").cast("double").alias("pression"),
    )
    row = anomalies.thresholds(df, accuracy=accuracy).first()
    for name, (_, share) in anomalies.THRESHOLDS.items():
        assert abs(row[name] - share * n) <= n / accuracy + 1


def test_flags_match_scores(readings):
    rows = [(f"2024-01-01 00:{i:02d}:00", "a", float(i + 1), 50.0, 1000.0 + i, float(i)) for i in range(60)]
    out = anomalies.detect_anomalies(readings(*rows), exact=True).collect()
    assert all((r["score_anomalie_temp"] != 0) == r["anomalie_temperature"] for r in out)
    assert sum(r["anomalie_temperature"] for r in out) == 2 + 3
    by_station = anomalies.detect_anomalies(readings(*rows), by="station", exact=True).collect()
    assert sum(r["anomalie_vent"] for r in by_station) == sum(r["anomalie_vent"] for r in out)


def test_thresholds_are_one_subquery_and_no_join(readings):
    df = readings(("2024-01-01 00:00:00", "a", 1.0))
    plan = anomalies.detect_anomalies(df)._jdf.queryExecution().executedPlan().toString()
    assert "Subquery" in plan and "Join" not in plan and "CartesianProduct" not in plan


def test_daily_summary_without_flags(readings):
    df = readings(("2024-01-01 00:00:00", "a", 1.0), ("2024-01-01 12:00:00", "a", 3.0))
    row = summaries.daily_summary(df).first()
    assert (row["date"], row["nb_mesures"], row["temp_moyenne"], row["nb_anomalies_temp"]) == ("2024-01-01", 2, 2.0, 0)


def test_latest_per_station(readings):
    df = readings(
        ("2024-01-01 00:00:00", "a", 9.0), ("2024-01-02 00:00:00", "a", 1.0), ("2024-01-01 00:00:00", "b", None)
    )
    got = {r["station"]: r["temperature"] for r in summaries.latest_per_station(df).collect()}
    assert got == {"a": 1.0, "b": None}


def test_completeness_and_period(readings):
    df = readings(("2024-01-01 00:00:00", "a", 9.0), ("2024-01-02 00:00:00", "a", None))
    got = {r["colonne"]: (r["non_nulls"], r["total"]) for r in summaries.completeness(df).collect()}
    assert got["temperature"] == (1, 2) and got["station"] == (2, 2) and got["humidite"] == (0, 2)
    assert summaries.station_count(df, approximate=True).first()[0] == 1


def test_station_names(readings, spark):
    stations = spark.createDataFrame([("a", "Station A")], "station string, station_name string")
    df = readings(("2024-01-01 00:00:00", "a", 1.0), ("2024-01-01 00:00:00", "z", 1.0))
    got = {r["station"]: r["station_name"] for r in joins.with_station_name(df, stations).collect()}
    assert got == {"a": "Station A", "z": None}
    plain = joins.join_checked(df, stations, ["station"], "left", max_rows=0)
    assert "BROADCAST" not in plain._jdf.queryExecution().analyzed().toString().upper()


def test_association_of_open_and_closed_events(readings, spark):
    df = readings(*[(f"2024-01-01 {h:02d}:00:00", s, float(h)) for h in range(10) for s in "ab"]).select(
        "station", "timestamp", "temperature"
    )
    events = spark.createDataFrame(
        [
            ("closed", "a", "2024-01-01 02:00:00", "2024-01-01 04:00:00"),
            ("open", "a", "2024-01-01 08:30:00", None),
            ("before", "b", "2023-01-01 00:00:00", "2024-01-01 01:30:00"),
            ("after", "b", "2025-01-01 00:00:00", None),
            ("elsewhere", "c", "2024-01-01 00:00:00", None),
        ],
        "nom string, station string, debut string, fin string",
    ).withColumns({c: F.col(c).cast("timestamp") for c in ("debut", "fin")})
    pairs = intervals.associate(df, events)
    got = sorted((r["nom"], r["temperature"]) for r in pairs.collect())
    assert got == [("before", 0.0), ("before", 1.0), ("closed", 2.0), ("closed", 3.0), ("open", 9.0)]
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert "_bucket" in plan
    stats = intervals.event_stats(df, events, "nom")
    found = {r["nom"]: (r["nb_mesures"], r["moyenne"]) for r in stats.collect()}
    assert found == {
        "closed": (2, 2.5),
        "open": (1, 9.0),
        "before": (2, 0.5),
        "after": (0, None),
        "elsewhere": (0, None),
    }


def test_event_figures_equal_brute_force(spark):
    """Edges down to a microsecond, times before 1970, a burst of one instant, zones of null, tiny and huge values."""
    rng = random.Random(8)
    spots = [rng.randrange(-10**15, 2 * 10**15) for _ in range(6)]
    near = lambda: rng.choice(spots) + rng.choice([0, 1, -1, rng.randrange(-50, 50), rng.randrange(-10**10, 10**10)])
    rows = [(rng.choice(["a", "b", None]), near(), rng.choice([None, float("nan"), float("inf"), rng.uniform(-5, 5)])) for _ in range(1500)]
    rows += [("a", spots[0], 3.0)] * 700
    rows += [("small", i, 3e-13) for i in range(10)] + [("large", i, 9e24) for i in range(10)] + [("huge", i, 1e26) for i in range(10)]
    events = [(i, rng.choice(["a", "b", None, "c"]), near(), rng.choice([near(), near(), None])) for i in range(300)]
    events += [(300 + i, z, -5, 7) for i, z in enumerate(("small", "large", "huge"))] + [(310, "a", None, 5), (311, "a", spots[0], spots[0])]
    df = spark.createDataFrame(rows, "station string, us long, temperature double").select(
        "station", F.timestamp_micros("us").alias("timestamp"), "temperature"
    )
    table = spark.createDataFrame(events, "id long, station string, a long, b long").select(
        "id", "station", F.timestamp_micros("a").alias("debut"), F.timestamp_micros("b").alias("fin")
    )
    found = {r.id: (r.nb_mesures, r.moyenne) for r in intervals.event_stats(df, table, "id").collect()}
    expected = {}
    for i, zone, a, b in events:
        if b is not None and (a is None or b < a):
            continue
        inside = [x for z, us, x in rows if z == zone and a is not None and a <= us and (b is None or us < b)]
        known = [x for x in inside if x is not None and math.isfinite(x)]
        expected[i] = (len(inside), sum(known) / len(known) if known else None)
    assert found.keys() == expected.keys()
    for i, (n, mean) in expected.items():
        assert found[i][0] == n and found[i][1] == (None if mean is None else pytest.approx(mean, rel=1e-9, abs=1e-25)), i


def test_an_event_of_many_buckets_joins_two(spark):
    rng = random.Random(5)
    buckets = [(z, at, rng.randrange(1, 5), rng.uniform(-5, 5)) for z in ("a", None) for at in rng.sample(range(-3000, 9000), 2500)]
    spans = [(rng.choice(["a", None, "b"]), e, i, i + rng.choice([-1, 0, 1, 17, 4000, 1 << 24])) for e, i in enumerate(rng.sample(range(-4000, 9000), 300))]
    hours = spark.createDataFrame([(z, at, n, n, x) for z, at, n, x in buckets], "_zone string, _at long, _n long, _k long, _mean double")
    got = intervals._whole_buckets(hours, spark.createDataFrame(spans, "_zone string, _event long, _i long, _j long")).collect()
    per_event = {}
    for r in got:
        per_event.setdefault(r._event, []).append(r)
    assert max(map(len, per_event.values())) == 2
    for zone, e, i, j in spans:
        inside = [(n, x) for z, at, n, x in buckets if z == zone and i <= at <= j]
        mine = per_event.get(e, [])
        assert sum(r._n for r in mine) == sum(n for n, _ in inside)
        assert sum(r._k * r._mean for r in mine) == pytest.approx(sum(n * x for n, x in inside), abs=1e-6)


def test_correlation_significance(spark):
    weather = spark.createDataFrame([("z", i, float(i)) for i in range(4)], "station string, h int, temperature double")
    at = F.timestamp_seconds(F.col("h") * 3600).alias("timestamp")
    weather = weather.select("station", at, "temperature")
    counts = [1, 2, 2, 4]
    activity = spark.createDataFrame([("z", h) for h, n in enumerate(counts) for _ in range(n)], "station string, h int")
    row = joins.weather_activity_correlation(weather, activity.select("station", at)).first()
    r = row["valeur_correlation"]
    assert r == pytest.approx(0.9233805168766388)
    assert row["significativite"] == pytest.approx(r * (2 / (1 - r * r)) ** 0.5)


def test_comoments_merge_without_the_readings(spark):
    """A month from days equals the month from its hours, beside a far-off reading; the schema is the declared one."""
    rng = random.Random(4)
    rows = [("z", h, 1e9 if h == 5 else 15 + rng.random()) for h in range(24 * 40)]
    weather = spark.createDataFrame(rows, "station string, h int, temperature double")
    at = F.timestamp_seconds(F.col("h") * 3600 + 1_704_067_200)
    weather = weather.select("station", at.alias("timestamp"), "temperature")
    counts = [(h, k, rng.randrange(3)) for h in range(24 * 40) for k in ("fete", "travaux")]
    events = spark.createDataFrame([("z", h, k) for h, k, n in counts for _ in range(n)], "station string, h int, type_evenement string")
    daily = correlations.comoments(weather, events.select("station", "type_evenement", at.alias("debut")))
    found = correlations.correlations(correlations.merged(daily, "month"))
    assert [(f.name, f.dataType) for f in found.schema.fields] == [(f.name, f.dataType) for f in CORRELATIONS.fields]
    rows_of = {(r.timestamp.month, r.variable_urbaine): r for r in found.collect()}
    assert len(rows_of) == 4
    for (month, kind), row in rows_of.items():
        hours = range(0, 31 * 24) if month == 1 else range(31 * 24, 24 * 40)
        x = [rows[h][2] for h in hours]
        y = [next(n for hh, k, n in counts if hh == h and k == kind) for h in hours]
        mx, my = sum(x) / len(x), sum(y) / len(y)
        r = sum((a - mx) * (b - my) for a, b in zip(x, y)) / math.sqrt(sum((a - mx) ** 2 for a in x) * sum((b - my) ** 2 for b in y))
        assert row.valeur_correlation == pytest.approx(r, abs=1e-9) and row.periode_analyse == "month"
        assert row.significativite == pytest.approx(r * math.sqrt((len(x) - 2) / (1 - r * r)), abs=1e-6)


@pytest.fixture()
def tables(readings, alerts):
    df = readings(
        *[(f"2024-01-30 {h:02d}:00:00", s, float(h), 50.0, 101000.0, 2.0 * h, 90.0, h / 10) for h in range(24) for s in "ab"]
    ).withColumn("station_name", F.upper("station"))
    metrics = df.withColumns({"temp_moy_7j": F.lit(1.0), "temp_volatilite_7j": F.lit(1.0), "indice_confort": F.lit("sec")})
    named = alerts.withColumns({c: F.lit(c) for c in ("type_alerte", "niveau", "zone")})
    return questions.Tables(df, metrics, named, station_compans="a", station_meteopole="b")


def test_every_route_has_a_query_that_runs(tables):
    from stationlab.functions.routing import DEFAULT_ROUTE, ROUTES

    assert set(questions.HANDLERS) == {name for _, name in ROUTES} | {DEFAULT_ROUTE}
    for name, handler in questions.HANDLERS.items():
        assert handler(tables, NOW, "sur 7 jours").count() > 0, name


def test_answer_and_its_figures(tables):
    hot = questions.answer("Quelle station est la plus chaude, quelle a le plus ?", tables, NOW)
    assert hot.columns == ["station_name", "valeur_moyenne", "valeur_max", "valeur_min"]
    one = questions.answer("Température caffarelli", tables, NOW)
    assert one.count() == 24
    assert questions.answer_stats(one).first()["amplitude"] == 23.0
    assert questions.answer_stats(hot) is None
    period = questions.answer("Température des 2 derniers jours", tables, NOW)
    assert questions.answer_stats(period).count() == 2
    with pytest.raises(ValueError):
        questions.answer("Alertes météo en cours", questions.Tables(tables.readings), NOW)


def test_ranking_words():
    from stationlab.functions.routing import ranking_of

    assert ranking_of("Quelle station est la plus froide ?") == ("temperature", True)
    assert ranking_of("la plus humide / le plus humide") == ("humidite", False)
    assert ranking_of("où y a-t-il le plus de vent ?") == ("vitesse_vent", False)
    assert ranking_of("laquelle ?") == ("temperature", False)


def test_views(spark, tables):
    views.register_views(tables.readings, tables.alerts, NOW)
    assert spark.table("v_dernieres_mesures").count() == 2
    assert spark.table("v_alertes_actives").count() == 2
    assert spark.table("v_stats_mensuelles").first()["nb_mesures"] == 24
