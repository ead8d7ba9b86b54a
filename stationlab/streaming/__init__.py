"""Structured Streaming counterparts of the batch operators."""

from stationlab.streaming.messages import (
    alerts_of,
    message_counts,
    others_of,
    parse_readings,
    readings_of,
    start_routes,
)
from stationlab.streaming.rolling import rolling_stream
from stationlab.streaming.run import start, start_console
from stationlab.streaming.windows import (
    drop_repeats,
    flag_with_stored,
    sliding_stats,
    tumbling_stats,
    with_event_time,
)

__all__ = [
    "alerts_of",
    "drop_repeats",
    "flag_with_stored",
    "message_counts",
    "others_of",
    "parse_readings",
    "readings_of",
    "rolling_stream",
    "sliding_stats",
    "start",
    "start_console",
    "start_routes",
    "tumbling_stats",
    "with_event_time",
]
