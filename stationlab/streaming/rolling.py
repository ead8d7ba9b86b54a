"""Rolling means, volatility and trend on a stream, kept as state per station.

Row-counted frames need rows in order, so a reading waits in the state until the
watermark has passed it.  The state holds the waiting readings and the last 720
temperatures; both are bounded, by the delay and by the longest frame.  Each frame is
reckoned from its own values, as in a batch: an extreme reading has no part in the frames that do not hold
it, and the size of a micro-batch none in the result.  Rows of one time follow each
other by the same hash as in a batch.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from stationlab.operators.filters import drop_incomplete
from stationlab.operators.frames import rolling
from stationlab.operators.windows import METRIC_NAMES, ROWS_7D, ROWS_24H, ROWS_30D, TREND
from stationlab.schemas import MEASURES, READINGS
from stationlab.streaming.windows import DEFAULT_DELAY, with_event_time

_NUMBERS = T.ArrayType(T.DoubleType())
STATE = T.StructType(
    [
        T.StructField("past", _NUMBERS),
        T.StructField("waiting_us", T.ArrayType(T.LongType())),
        T.StructField("waiting_tie", T.ArrayType(T.LongType())),
        *[T.StructField(m, _NUMBERS) for m in MEASURES],
    ]
)
_METRICS = [*[name for pair in METRIC_NAMES for name in pair], TREND]
OUTPUT = T.StructType([*READINGS.fields, *[T.StructField(m, T.DoubleType()) for m in _METRICS]])


def metrics_after(past: np.ndarray, values: np.ndarray) -> dict[str, np.ndarray]:
    """Metrics of ``values``, which follow ``past`` in time."""
    line = np.concatenate([past, values])
    size, out = len(values), {}
    for rows, names in zip((ROWS_7D, ROWS_30D), METRIC_NAMES):
        out |= {name: x[len(past) :] for name, x in zip(names, rolling(line, rows))}
    before = np.concatenate([np.full(ROWS_24H, np.nan), line])[-(size + ROWS_24H) : -ROWS_24H]
    out[TREND] = values - before
    return out


def _advance(
    key: tuple[str], chunks: Iterator[pd.DataFrame], state: GroupState
) -> Iterator[pd.DataFrame]:
    columns = ["us", "tie", *MEASURES]
    past = np.array([], dtype=float)
    parts = []
    if state.exists:
        held = state.get
        past = np.array(held[0], dtype=float)
        parts.append(pd.DataFrame(dict(zip(columns, held[1:]))))
    for chunk in chunks:
        us = chunk["timestamp"].astype("datetime64[us]").astype("int64")
        parts.append(chunk[["tie", *MEASURES]].assign(us=us)[columns])
    waiting = pd.concat(parts, ignore_index=True) if parts else pd.DataFrame(columns=columns)
    waiting = waiting.astype({"us": "int64", "tie": "int64", **dict.fromkeys(MEASURES, "float64")})
    waiting = waiting.sort_values(columns, kind="stable", ignore_index=True)

    ready = waiting["us"] <= state.getCurrentWatermarkMs() * 1000
    done, waiting = waiting[ready], waiting[~ready]
    if len(done):
        metrics = metrics_after(past, done["temperature"].to_numpy())
        past = np.concatenate([past, done["temperature"].to_numpy()])[-ROWS_30D:]
        times = pd.to_datetime(done["us"].to_numpy(), unit="us")
        out = pd.DataFrame({"timestamp": times, "station": key[0]})
        for name in MEASURES:
            out[name] = done[name].to_numpy()
        yield out.assign(**metrics)[OUTPUT.names]

    state.update((past.tolist(), *[waiting[c].tolist() for c in columns]))
    if len(waiting):
        # Wake up once the watermark has passed the earliest waiting reading.
        earliest_ms = int(waiting["us"].min()) // 1000
        state.setTimeoutTimestamp(max(earliest_ms, state.getCurrentWatermarkMs() + 1))


def rolling_stream(readings: DataFrame, delay: str | None = DEFAULT_DELAY) -> DataFrame:
    """The row-counted metrics of every complete reading, in time order per station.

    ``delay`` None says that the rows carry a watermark already.
    A reading comes out once the watermark passes it; one that arrives after that
    is dropped.  On the same rows the result equals ``rolling_metrics`` in a batch.
    """
    timed = with_event_time(readings, delay) if delay else readings
    rows = drop_incomplete(timed).select(*READINGS.names)
    rows = rows.withColumn("tie", F.xxhash64(*READINGS.names))
    return rows.groupBy("station").applyInPandasWithState(
        _advance, OUTPUT, STATE, "append", GroupStateTimeout.EventTimeTimeout
    )
