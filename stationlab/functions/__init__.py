"""Column functions: Column (or column name) in, Column out."""

from stationlab.functions.anomaly import is_above, is_outside, score_above, score_outside
from stationlab.functions.comfort import (
    comfort_class,
    comfort_index,
    felt_temperature,
    felt_temperature_sql,
    rain_risk,
)
from stationlab.functions.convert import (
    day_string,
    decode_bytes,
    from_epoch_millis,
    has_any_term,
    has_entity,
    json_field,
    nan_to_null,
    or_default,
    parse_json_message,
    parse_timestamp,
    payload_preview,
    pressure_to_pa,
    rain_to_show,
    terms,
    to_json_message,
)
from stationlab.functions.routing import ROUTES, classify_question, first_number, route_of
from stationlab.functions.sql import register_sql_functions

__all__ = [
    "ROUTES",
    "classify_question",
    "comfort_class",
    "comfort_index",
    "day_string",
    "decode_bytes",
    "felt_temperature",
    "felt_temperature_sql",
    "first_number",
    "from_epoch_millis",
    "has_any_term",
    "has_entity",
    "is_above",
    "is_outside",
    "json_field",
    "nan_to_null",
    "or_default",
    "parse_json_message",
    "parse_timestamp",
    "payload_preview",
    "pressure_to_pa",
    "rain_risk",
    "rain_to_show",
    "register_sql_functions",
    "route_of",
    "score_above",
    "score_outside",
    "terms",
    "to_json_message",
]
