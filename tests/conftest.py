import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from stationlab.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(
        "stationlab-tests",
        cores="4",
        **{"spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoint"))},
    )
    yield session
    session.stop()


@pytest.fixture()
def readings(spark):
    """Make readings from (time, station, temperature, humidity, pressure, wind, direction, rain)."""
    from stationlab.schemas import READINGS

    def make(*rows):
        text = ["timestamp string", "station string"] + [
            f"{f.name} double" for f in READINGS.fields[2:]
        ]
        filled = [tuple(r) + (None,) * (8 - len(r)) for r in rows]
        df = spark.createDataFrame(filled, ", ".join(text))
        return df.withColumn("timestamp", df["timestamp"].cast("timestamp"))

    return make
