import json
import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from stationlab.operators.dedup import DuplicateKeys
from stationlab.operators.filters import since
from stationlab.operators.ordering import newest
from stationlab.plans import jobs
from stationlab.schemas import READINGS
from stationlab.sinks import external, files
from stationlab.sources import files as landed
from stationlab.sources import messages, tables

HEADER = "timestamp,station,temperature,humidite,pression,vitesse_vent,direction_vent,precipitation"


def put(folder, name, text):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_csv_readings(spark, tmp_path):
    path = put(
        tmp_path, "r.csv", f"{HEADER}\n2024-01-01T00:00:00Z,a,1.5,,101000,NaN,90,0\n2024-01-01 01:00:00,b,,50,,,,\n"
    )
    df = landed.read_readings_csv(spark, path)
    assert df.schema == READINGS
    first = df.filter("station = 'a'").first()
    assert first["timestamp"] == datetime(2024, 1, 1) and first["vitesse_vent"] is None


def test_csv_without_station_fails(spark, tmp_path):
    path = put(tmp_path, "bad.csv", HEADER.replace("station,", "") + "\n2024-01-01 00:00:00,1,2,3,4,5,6\n")
    with pytest.raises(Exception, match="column in CSV header"):
        landed.read_readings_csv(spark, path).collect()


def test_latest_drop(spark, tmp_path):
    for age, name in ((30, "meteo_a.csv"), (10, "meteo_b.csv"), (20, "sub/meteo_c.csv"), (1, "other.txt")):
        path = put(tmp_path, name, "x")
        stamp = 1_700_000_000 - age
        os.utime(path, (stamp, stamp))
    assert landed.latest_drop(spark, str(tmp_path), "meteo_*.csv").endswith("meteo_b.csv")
    assert landed.latest_drop(spark, str(tmp_path), "*.none") is None


def page(*records):
    return json.dumps({"total_count": len(records), "results": list(records)}, ensure_ascii=False, indent=1)


def record(hour, temperature, **more):
    return {
        "heure_utc": f"2024-06-10T{hour:02d}:00:00+00:00",
        "temperature_en_degre_c": temperature,
        "humidite": 55,
        "pression": 101300,
        "force_moyenne_du_vecteur_vent": "12.5",
        "direction_du_vecteur_vent_moyen": 180,
        "pluie": 0.2,
        "type_de_station": "ISS",
        "heure_de_paris": f"2024-06-10T{hour + 2:02d}:00:00+02:00",
        **more,
    }


def test_api_envelopes(spark, tmp_path):
    path = put(tmp_path, "p.json", page(record(10, 21.5), record(11, "22"), record(12, None), record(13, "n/a"), record(14, "NaN")))
    df = landed.read_api_envelopes(spark, path, "s1", "Station 1").orderBy("timestamp")
    rows = df.collect()
    assert [r["temperature"] for r in rows] == [21.5, 22.0, None, None, None]
    assert rows[0]["timestamp"] == datetime(2024, 6, 10, 10) and rows[0]["vitesse_vent"] == 12.5
    assert rows[0]["station"] == "s1" and rows[0]["station_type"] == "ISS" and rows[0]["rafale_max"] is None
    assert newest(df, 1).first()["timestamp"] == datetime(2024, 6, 10, 14)


@pytest.fixture()
def stations(spark):
    return spark.createDataFrame([("s1", "Un"), ("s2", "Deux")], "station string, station_name string")


def test_all_stations_in_one_read(spark, tmp_path, stations):
    put(tmp_path, "station=s1/p.json", page(record(10, 1.0), record(11, 2.0)))
    put(tmp_path, "station=s2/p.json", page(record(10, 3.0)))
    df = landed.read_all_stations(spark, str(tmp_path), stations)
    got = sorted((r["station"], r["station_name"], r["temperature"]) for r in df.collect())
    assert got == [("s1", "Un", 1.0), ("s1", "Un", 2.0), ("s2", "Deux", 3.0)]
    plan = df.filter("station = 's2'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(station" in plan


def test_city_weather_bulletins_and_documents(spark, tmp_path):
    city = {"name": "Toulouse", "main": {"temp": 20.5, "humidity": 60, "pressure": 1013}, "wind": {"speed": 3.0, "deg": 90}, "weather": [{"description": "ciel dégagé"}]}
    path = put(tmp_path, "city.json", json.dumps([city, {"name": "Vide"}]))
    full, bare = landed.read_city_weather(spark, path).orderBy("station").collect()
    assert full["pression"] == 101300.0 and full["description"] == "ciel dégagé" and full["timestamp"]
    assert bare["temperature"] is None and bare["description"] is None

    path = put(tmp_path, "alert.json", json.dumps({"results": [{"type_alerte": "Vent", "niveau": "Orange", "zone": "31", "message": "fort"}]}))
    row = landed.read_alert_bulletins(spark, path).first()
    assert (row["type_alerte"], row["niveau"], row["zone"], row["description"]) == ("Vent", "Orange", "31", "fort")

    docs = [
        {"titre": "A", "timestamp": "2024-06-10T15:00:00Z", "type_evenement": "test", "metadonnees": {"niveau_confiance": 0.9, "entites_extraites": ["x", "y"]}},
        {"titre": "B", "timestamp": "?", "contenu": "c", "entites_extraites": ["z"], "metadonnees": {"type_evenement": "canicule"}, "associations": [{"type": "t", "correlation": 0.95}]},
    ]
    path = put(tmp_path, "docs.json", "\n".join(json.dumps(d) for d in docs))
    a, b = landed.read_event_documents(spark, path).orderBy("titre").collect()
    assert a["entites_extraites"] == ["x", "y"] and a["timestamp"] == datetime(2024, 6, 10, 15)
    assert b["type_evenement"] == "canicule" and b["timestamp"] is None and b["description"] == "c"
    assert b["associations"][0]["correlation"] == 0.95


def test_connector_options():
    assert messages.kafka_options(["a:1", "b:2"], messages.topics_of("all"), per_trigger=10) == {
        "kafka.bootstrap.servers": "a:1,b:2",
        "subscribe": "topic_meteo_temps_reel,topic_alertes_meteo,topic_evenements_urbains",
        "startingOffsets": "latest",
        "maxOffsetsPerTrigger": "10",
    }
    with pytest.raises(ValueError):
        messages.topics_of("autre")
    url = tables.postgres_url("h", 5432, "d")
    assert tables.jdbc_options(url, "t", "u", "p")["url"] == "jdbc:postgresql://h:5432/d"
    with pytest.raises(ValueError):
        tables.jdbc_options("postgresql://h/d", "t", "u", "p")


def test_messages_leave_out_missing_fields(readings):
    df = readings(("2024-01-01 00:00:00", "a", 1.5, float("nan"), None, 2.0))
    row = external.to_messages(df).first()
    assert row["key"] == "a"
    assert json.loads(row["value"]) == {"station": "a", "timestamp": "2024-01-01 00:00:00", "temperature": 1.5, "vitesse_vent": 2.0}


def test_csv_sink(readings, tmp_path):
    df = readings(*[(f"2024-01-01 {h:02d}:00:00", "a", float(h)) for h in range(10)]).repartition(4)
    files.write_csv(df, str(tmp_path / "many"))
    files.write_csv(df, str(tmp_path / "one"), single_file=True)
    assert len(list((tmp_path / "one").glob("*.csv"))) == 1
    assert len(list((tmp_path / "many").glob("*.csv"))) > 1
    again = landed.read_readings_csv(df.sparkSession, str(tmp_path / "many"))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, df.collect()))


def test_raw_drop_and_created_at(readings, tmp_path, spark):
    df = readings(("2024-01-01 00:00:00", "a", 1.0), ("2024-01-01 00:00:00", "b", 2.0))
    path = files.land_raw(df, str(tmp_path), "meteo", datetime(2024, 1, 2, 3, 4, 5))
    assert path.endswith("meteo_20240102_030405") and os.path.isdir(f"{path}/station=b")
    files.write_readings(df, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).filter("created_at IS NOT NULL").count() == 2


def test_stored_table_inserts(readings, tmp_path, spark):
    path = str(tmp_path / "table")
    first = readings(("2024-01-01 00:00:00", "a", 1.0), ("2024-01-01 00:00:00", "a", 1.0))
    assert files.seed_if_empty(first.limit(1), path) and not files.seed_if_empty(first, path)
    files.store_new(first, path)
    files.store_new(readings(("2024-01-01 01:00:00", "a", 2.0), ("2024-01-01 00:00:00", "a", 9.0)), path)
    assert sorted(r["temperature"] for r in spark.read.parquet(path).collect()) == [1.0, 2.0]
    with pytest.raises(DuplicateKeys):
        files.store_unique(readings(("2024-01-01 01:00:00", "a", 5.0)), path)
    files.store_unique(readings(("2024-01-01 02:00:00", "a", 5.0)), path)
    assert spark.read.parquet(path).count() == 3


def test_batch_job(spark, readings, tmp_path):
    rows = [(f"2024-01-{1 + h // 24:02d} {h % 24:02d}:00:00", "a", 10.0 + h % 7, 55.0, 101000.0, 5.0, 90.0, 0.0) for h in range(200)]
    files.write_csv(readings(*rows, (None, "a", 3.0)), str(tmp_path / "in"))
    out = jobs.run_batch(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    assert out.count() == 200
    last = out.orderBy(F.desc("timestamp")).first()
    values = [10.0 + h % 7 for h in range(31, 200)]
    assert last["temp_moy_7j"] == pytest.approx(sum(values) / 169)
    assert last["temp_tendance_24h"] == pytest.approx((10 + 199 % 7) - (10 + 175 % 7))
    assert last["indice_confort"] in {"froid", "modere", "optimal"}
    staged = jobs.run_batch(spark, str(tmp_path / "in"), str(tmp_path / "out2"), staging=str(tmp_path / "s"))
    assert sorted(map(str, staged.collect())) == sorted(map(str, out.collect()))


def test_last_days_of_collected_rows(spark, tmp_path):
    """Offsets in the source times are honoured, and the cut-off is in UTC."""
    shifted = {"heure_utc": "2024-06-09T01:30:00+02:00"}
    path = put(tmp_path, "p.json", page(record(10, 1.0), record(1, 2.0, **shifted)))
    df = landed.read_api_envelopes(spark, path, "s", "S")
    assert since(df, "2024-06-10 12:00:00", 1).count() == 1
    assert since(df, "2024-06-10 23:30:00", 2).count() == 2
    assert since(df, "2024-06-10 23:30:01", 2).count() == 1


def test_collect_and_process_can_be_repeated(spark, tmp_path, stations):
    put(tmp_path, "pages/station=s1/p.json", page(record(10, 1.0), record(11, 3.0)))
    put(tmp_path, "pages/station=s2/p.json", page(record(10, 3.0), record(10, 3.0)))
    args = (str(tmp_path / "pages"), stations, str(tmp_path / "table"), str(tmp_path / "results"))
    for _ in range(2):
        summary = jobs.collect_and_process(spark, *args)
        got = {r["station"]: (r["nb_mesures"], r["temp_moyenne"]) for r in summary.collect()}
        assert got == {"s1": (2, 2.0), "s2": (1, 3.0)}
