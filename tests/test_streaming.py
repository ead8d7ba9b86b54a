import json
import math
import os
from datetime import datetime, timedelta
from itertools import count

import pytest
from pyspark.sql import functions as F

from stationlab import streaming
from stationlab.operators import metrics, windows
from stationlab.operators.anomalies import flag_anomalies, thresholds
from stationlab.plans import jobs
from stationlab.schemas import READINGS, TOPIC_ALERTS, TOPIC_READINGS, TOPIC_URBAN, WIRE
from stationlab.sources import messages
from stationlab.sources.files import project_api_records
from stationlab.streaming.run import query_checkpoint, start_memory

_names = count()


def message(topic, value, at="2024-01-01 00:00:00"):
    body = value if isinstance(value, str) else json.dumps(value)
    return {"key": "k", "value": body, "topic": topic, "timestamp": at}


def reading(hour, station="a", temperature=None, **more):
    at = datetime(2024, 1, 1) + timedelta(hours=hour)
    body = {"station": station, "timestamp": f"{at:%Y-%m-%d %H:%M:%S}", **more}
    if temperature is not None:
        body["temperature"] = temperature
    return body


@pytest.fixture()
def inbox(tmp_path):
    """A folder of message files in arrival order."""
    folder = tmp_path / "inbox"
    folder.mkdir()
    number = count(1_700_000_000)

    def put(*rows):
        stamp = next(number)
        path = folder / f"{stamp}.json"
        path.write_text("\n".join(json.dumps(r) for r in rows))
        os.utime(path, (stamp, stamp))

    put.folder = str(folder)
    return put


def run(spark, df, mode="append"):
    name = f"stream_{next(_names)}"
    query = start_memory(df, name, mode=mode)
    query.awaitTermination(120)
    return spark.table(name)


def stream(spark, inbox):
    return messages.read_message_files_stream(spark, inbox.folder, files_per_trigger=1)


def test_parse_and_enrich(spark, inbox):
    inbox(
        message(TOPIC_READINGS, reading(1, temperature=31.0, humidite=85.0, pression=100000.0)),
        message(TOPIC_READINGS, '{"station": "a", "timestamp": "2024-01-01 02:00:00", "temperature": NaN}'),
        message(TOPIC_READINGS, "{broken"),
        message(TOPIC_READINGS, {"station": "a", "timestamp": "never", "temperature": 1.0}),
    )
    out = run(spark, metrics.enrich(streaming.parse_readings(stream(spark, inbox))))
    assert out.count() == 4
    hot = out.filter("indice_confort = 'trop_chaud'").collect()
    assert len(hot) == 1 and hot[0]["risque_precipitation"] == "eleve" and hot[0]["kafka_timestamp"]
    assert out.filter("temperature = 1.0").first()["timestamp"] is None


def test_routes_and_counts(spark, inbox, tmp_path):
    inbox(
        message(TOPIC_READINGS, reading(1, temperature=1.0)),
        message(TOPIC_ALERTS, {"type_alerte": "Vent", "zone": "z", "debut": "2024-01-01T00:00:00Z"}),
        message(TOPIC_URBAN, {"texte": "x" * 200}),
    )
    inbox(message(TOPIC_READINGS, reading(2, temperature=2.0)))
    folder = str(tmp_path / "routes")
    query = streaming.start_routes(stream(spark, inbox), folder, str(tmp_path / "cp"))
    query.awaitTermination(120)
    assert spark.read.parquet(f"{folder}/readings").count() == 2
    alert = spark.read.parquet(f"{folder}/alerts").first()
    assert (alert["type_alerte"], alert["niveau"]) == ("Vent", "Unknown")
    other = spark.read.parquet(f"{folder}/others").first()
    assert len(other["apercu"]) == 100 and len(other["value"]) > 200
    # The same batches again leave the same files.
    streaming.start_routes(stream(spark, inbox), folder, str(tmp_path / "cp2")).awaitTermination(120)
    assert spark.read.parquet(f"{folder}/readings").count() == 2

    counts = run(spark, streaming.message_counts(stream(spark, inbox)), mode="complete")
    assert {r["topic"]: r["nb_messages"] for r in counts.collect()} == {TOPIC_READINGS: 2, TOPIC_ALERTS: 1, TOPIC_URBAN: 1}


def values(n, station):
    shift = 0 if station == "a" else 5
    return [((i * 7919) % 451) / 10 - 5 + shift for i in range(n)]


def fill(inbox, hours, stations=("a", "b"), files=4):
    """Readings of each station spread over files in time order, then one far later."""
    per_file = math.ceil(hours / files)
    for first in range(0, hours, per_file):
        inbox(
            *[
                message(TOPIC_READINGS, reading(h, s, values(hours, s)[h], humidite=50.0))
                for h in range(first, min(first + per_file, hours))
                for s in stations
            ]
        )
    inbox(*[message(TOPIC_READINGS, reading(hours + 2000, s, 0.0)) for s in stations])


def as_batch(spark, inbox):
    raw = spark.read.schema(messages.MESSAGES).json(inbox.folder)
    return streaming.parse_readings(raw).select(*READINGS.names)


METRICS = [*[n for pair in windows.METRIC_NAMES for n in pair], windows.TREND]


def compare(ours, theirs):
    keys = ["station", "timestamp"]
    a = {tuple(r[k] for k in keys): [r[m] for m in METRICS] for r in ours.collect()}
    b = {tuple(r[k] for k in keys): [r[m] for m in METRICS] for r in theirs.collect()}
    assert a.keys() == b.keys() and len(a) == ours.count()
    for key, row in a.items():
        for x, y in zip(row, b[key]):
            assert (x is None) == (y is None), key
            assert x is None or math.isclose(x, y, abs_tol=1e-9), key


def test_rolling_equals_batch(spark, inbox):
    fill(inbox, 900)
    out = run(spark, streaming.rolling_stream(streaming.parse_readings(stream(spark, inbox))))
    settled = out.filter("timestamp < '2024-02-20'")
    expected = windows.rolling_metrics(as_batch(spark, inbox)).filter("timestamp < '2024-02-20'")
    assert expected.count() == 1800
    compare(settled, expected)


@pytest.mark.parametrize("files", [1, 5, 12])
def test_rolling_keeps_an_extreme_reading_inside_its_frames(spark, inbox, files):
    """Equal to the batch, whatever the size of a micro-batch, with an extreme value and rows of one time."""
    rows = [message(TOPIC_READINGS, reading(h, "a", 1e17 if h == 100 else 10 + h * 7919 % 1000 / 100, humidite=50.0)) for h in range(900)]
    rows += [message(TOPIC_READINGS, reading(h, "a", float(k), humidite=50.0)) for h in (50, 51, 400) for k in range(6)]
    order = sorted(range(len(rows)), key=lambda i: i if i < 900 else (50, 51, 400)[(i - 900) // 6])
    for k in range(files):
        inbox(*[rows[i] for i in order[k * len(rows) // files : (k + 1) * len(rows) // files]])
    inbox(message(TOPIC_READINGS, reading(3000, "a", 0.0)))
    out = run(spark, streaming.rolling_stream(streaming.parse_readings(stream(spark, inbox)), delay="3 hours"))
    names = ["timestamp", "temperature", *METRICS]
    both = []
    for df in (out, windows.rolling_metrics(as_batch(spark, inbox))):
        found = df.filter("timestamp < '2024-03-01'").select(names).collect()
        both.append({(r[0], r[1]): r[2:] for r in found})
    assert both[0].keys() == both[1].keys() and len(both[0]) == len(rows)
    for key, row in both[0].items():
        for x, y in zip(row, both[1][key]):
            assert (x is None) == (y is None) and (x is None or math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9)), key
    late = [r for (at, _), r in both[0].items() if at.isoformat() > "2024-01-20"]
    assert late and all(r[1] < 100 for r in late)


def test_rolling_puts_late_rows_in_order_and_drops_too_late_ones(spark, inbox):
    inbox(*[message(TOPIC_READINGS, reading(h, temperature=float(h))) for h in (0, 3, 1)])
    inbox(*[message(TOPIC_READINGS, reading(h, temperature=float(h))) for h in (2, 5)])
    inbox(message(TOPIC_READINGS, reading(0, temperature=99.0)))
    inbox(message(TOPIC_READINGS, reading(40, temperature=0.0)))
    df = streaming.rolling_stream(streaming.parse_readings(stream(spark, inbox)), delay="2 hours")
    out = run(spark, df).filter("temperature > 0 OR timestamp < '2024-01-01 12:00:00'")
    got = [(r["temperature"], r["temp_moy_7j"]) for r in out.orderBy("timestamp").collect()]
    assert got == [(0.0, 0.0), (1.0, 0.5), (2.0, 1.0), (3.0, 1.5), (5.0, 2.2)]


def test_restart_continues_from_the_checkpoint(spark, inbox, tmp_path):
    fill(inbox, 300, files=3)
    target, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")

    def work():
        jobs.run_stream(stream(spark, inbox), checkpoint, target, trigger=None).awaitTermination(180)

    work()
    before = spark.read.parquet(target).count()
    # Repeats of what was sent, and news.
    inbox(*[message(TOPIC_READINGS, reading(2300, s, 0.0)) for s in "ab"], *[message(TOPIC_READINGS, reading(2300, "a", 0.0))])
    inbox(*[message(TOPIC_READINGS, reading(2400, s, 0.0)) for s in "ab"])
    work()
    out = spark.read.parquet(target)
    # The rows at hour 2300 come out once; those at hour 2400 still wait.
    assert before == 600 and out.count() == 600 + 2
    first = out.filter("timestamp < '2024-02-01'")
    assert first.count() == 600 and "indice_confort" in out.columns
    compare(first, windows.rolling_metrics(as_batch(spark, inbox)).filter("timestamp < '2024-02-01'"))


def test_repeats_are_dropped(spark, inbox):
    body = [message(TOPIC_READINGS, reading(h, temperature=float(h))) for h in range(3)]
    inbox(*body)
    inbox(*body, message(TOPIC_READINGS, reading(3, temperature=3.0)))
    rows = streaming.with_event_time(streaming.parse_readings(stream(spark, inbox)), "10 hours")
    out = run(spark, streaming.drop_repeats(rows))
    assert sorted(r["temperature"] for r in out.collect()) == [0.0, 1.0, 2.0, 3.0]


@pytest.mark.parametrize("stats", [streaming.tumbling_stats, streaming.sliding_stats])
def test_event_time_windows_equal_batch(spark, inbox, stats):
    fill(inbox, 60)
    # A row long behind the watermark is dropped, one batch after the watermark moved.
    inbox(message(TOPIC_READINGS, reading(2100, temperature=0.0)))
    inbox(message(TOPIC_READINGS, reading(1, temperature=500.0)))
    rows = streaming.with_event_time(streaming.parse_readings(stream(spark, inbox)))
    out = run(spark, stats(rows)).filter("fin < '2024-01-20'")
    batch = stats(as_batch(spark, inbox).filter("temperature IS NULL OR temperature < 400")).filter("fin < '2024-01-20'")

    def bag(df):
        return sorted(
            tuple(round(v, 9) if isinstance(v, float) else str(v) for v in r) for r in df.collect()
        )

    assert bag(out) == bag(batch) and out.count() > 0


def test_window_takes_times_without_zone(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ'2024-01-01 00:30:00' AS timestamp, 'a' AS station, 1.0D AS temperature")
    row = streaming.tumbling_stats(streaming.with_event_time(df)).first()
    assert str(row["debut"]) == "2024-01-01 00:00:00"


def test_stored_thresholds(spark, inbox, tmp_path):
    fill(inbox, 100)
    batch = as_batch(spark, inbox)
    path = str(tmp_path / "limits")
    thresholds(batch, exact=True).write.parquet(path)
    limits = spark.read.parquet(path)
    out = run(spark, streaming.flag_with_stored(streaming.parse_readings(stream(spark, inbox)), limits))
    expected = flag_anomalies(batch, limits)
    assert out.filter("anomalie_temperature").count() == expected.filter("anomalie_temperature").count() > 0
    with pytest.raises(ValueError):
        streaming.flag_with_stored(batch, limits.union(limits))


def test_landed_pages_as_a_stream(spark, tmp_path):
    folder = tmp_path / "pages" / "station=s1"
    folder.mkdir(parents=True)
    page = {"total_count": 1, "results": [{"heure_utc": "2024-01-01T00:00:00+00:00", "temperature_en_degre_c": 4}]}
    (folder / "p.json").write_text(json.dumps(page))
    pages = messages.read_landing_stream(spark, str(tmp_path / "pages"))
    out = run(spark, project_api_records(pages.select("station", F.inline("results")), "station"))
    assert [(r["station"], r["temperature"]) for r in out.collect()] == [("s1", 4.0)]


def test_console_and_checkpoint_folder(spark, inbox, tmp_path):
    inbox(message(TOPIC_READINGS, reading(1, temperature=1.0)))
    query = streaming.start_console(streaming.parse_readings(stream(spark, inbox)), str(tmp_path / "cp"), trigger=None)
    query.awaitTermination(60)
    assert query.exception() is None
    folder = spark.conf.get("spark.checkpoint.dir")
    assert query_checkpoint(spark, "q") == f"{folder}/queries/q"
    assert WIRE.names[0] == "station"
