"""Casting, parsing and display helpers."""

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def day_string(ts: Column | str) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def parse_timestamp(text: Column | str) -> Column:
    """ISO text to timestamp; bad text becomes null instead of failing the job."""
    return F.try_to_timestamp(_col(text))


def decode_bytes(value: Column | str) -> Column:
    return _col(value).cast("string")


def parse_json_message(value: Column | str, schema: T.StructType) -> Column:
    return F.from_json(decode_bytes(value), schema)


def to_json_message(*columns: Column | str) -> Column:
    """JSON text of the columns; null fields are left out."""
    return F.to_json(F.struct(*columns))


def from_epoch_millis(millis: Column | str) -> Column:
    return F.timestamp_millis(_col(millis).cast("long"))


def payload_preview(text: Column | str, length: int = 100) -> Column:
    """The first characters of a payload, for display."""
    return F.substring(_col(text), 1, length)


def or_default(value: Column | str, default: str = "Unknown") -> Column:
    return F.coalesce(_col(value).cast("string"), F.lit(default))


def json_field(metadata: Column | str, path: str, kind: str) -> Column:
    """A typed field of JSON text; null when the text or the field is unusable."""
    return F.try_variant_get(F.try_parse_json(_col(metadata)), path, kind)


def has_entity(entities: Column | str, entity: str) -> Column:
    return F.coalesce(F.array_contains(_col(entities), entity), F.lit(False))


def terms(text: Column | str) -> Column:
    """Lower-cased words of a text, split at anything but letters and digits."""
    return F.split(F.lower(_col(text)), r"[^\p{L}\p{N}]+")


def has_any_term(text: Column | str, wanted: list[str]) -> Column:
    wanted_terms = F.array(*[F.lit(w.lower()) for w in wanted])
    return F.coalesce(F.arrays_overlap(terms(text), wanted_terms), F.lit(False))


def rain_to_show(precipitation: Column | str = "precipitation") -> Column:
    return F.coalesce(_col(precipitation) > 0, F.lit(False))


def nan_to_null(x: Column | str) -> Column:
    return F.nullif(_col(x), F.lit(float("nan")))


def pressure_to_pa(pressure: Column | str, unit: str = "Pa") -> Column:
    factors = {"Pa": 1.0, "hPa": 100.0}
    if unit not in factors:
        raise ValueError(f"unknown pressure unit {unit!r}")
    return _col(pressure) if unit == "Pa" else _col(pressure) * factors[unit]
