"""Comfort, rain risk and felt temperature.

Each classification is an ordered table of (label, condition); the first
condition that is true wins, and a null condition counts as false.  The labels
and limits are fixed values.
"""

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Rule = tuple[str, Callable[..., Column]]

# Comfort index of the metrics table.
COMFORT_INDEX: Sequence[Rule] = (
    ("optimal", lambda t, h: t.between(18, 24) & h.between(40, 60)),
    ("trop_chaud", lambda t, h: t > 30),
    ("chaud_humide", lambda t, h: (t > 25) & (h > 70)),
    ("tres_froid", lambda t, h: t < 5),
    ("froid", lambda t, h: t < 10),
    ("tres_humide", lambda t, h: h > 80),
    ("sec", lambda t, h: h < 30),
)

# Comfort class of the SQL function.
COMFORT_CLASS: Sequence[Rule] = (
    ("inconnu", lambda t, h: t.isNull() | h.isNull()),
    ("optimal", lambda t, h: t.between(18, 24) & h.between(40, 60)),
    ("trop_chaud", lambda t, h: (t > 30) | ((t > 25) & (h > 70))),
    ("froid", lambda t, h: t < 10),
    ("humide", lambda t, h: h > 80),
    ("sec", lambda t, h: h < 30),
)

# Rain risk from humidity (%) and pressure (Pa).
RAIN_RISK: Sequence[Rule] = (
    ("eleve", lambda h, p: (h > 80) & (p < 101000)),
    ("modere", lambda h, p: h > 70),
    ("faible", lambda h, p: h > 60),
)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _first_match(rules: Sequence[Rule], default: str, *args: Column | str) -> Column:
    cols = [_col(a) for a in args]
    return reduce(
        lambda rest, rule: F.when(rule[1](*cols), F.lit(rule[0])).otherwise(rest),
        reversed(rules),
        F.lit(default),
    )


def comfort_index(temperature="temperature", humidity="humidite") -> Column:
    return _first_match(COMFORT_INDEX, "modere", temperature, humidity)


def comfort_class(temperature="temperature", humidity="humidite") -> Column:
    """As :func:`comfort_index` but coarser, and ``inconnu`` when an input is null."""
    return _first_match(COMFORT_CLASS, "modere", temperature, humidity)


def rain_risk(humidity="humidite", pressure="pression") -> Column:
    return _first_match(RAIN_RISK, "tres_faible", humidity, pressure)


def felt_temperature(
    temperature="temperature", humidity="humidite", wind="vitesse_vent"
) -> Column:
    """Wind chill below 10 °C, heat index above 25 °C; a null input that is needed gives null."""
    t, h, w = _col(temperature), _col(humidity), _col(wind)
    # Limits and factors.
    return F.when(t < 10, t - w * 0.5).when(t > 25, t + (h - 50) * 0.1).otherwise(t)


def felt_temperature_sql(
    temperature="temperature", humidity="humidite", wind="vitesse_vent"
) -> Column:
    """As :func:`felt_temperature`, but any null input leaves the temperature unchanged."""
    t, h, w = _col(temperature), _col(humidity), _col(wind)
    known = t.isNotNull() & h.isNotNull() & w.isNotNull()
    return F.when(known, felt_temperature(t, h, w)).otherwise(t)
