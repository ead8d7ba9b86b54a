"""Which named query a French question asks for."""

import re
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns searched in the lower-cased question, first match wins.
ROUTES: tuple[tuple[str, str], ...] = (
    (r"température.*([0-9]+).*jours?", "temperature_period"),
    (r"température.*aujourd'hui|maintenant|actuelle", "current"),
    (r"température.*maximum|minimale?|extrême", "extremes"),
    (r"température.*compans|caffarelli", "station_compans"),
    (r"température.*méteopole", "station_meteopole"),
    (r"pluie|précipitation", "precipitation"),
    (r"il.*pleut|va pleuvoir", "rain_forecast"),
    (r"vent.*fort|rafale", "strong_wind"),
    (r"direction.*vent", "wind_direction"),
    (r"compar.*station|différence.*station", "station_comparison"),
    (r"quelle.*station.*plus|moins", "station_ranking"),
    (r"tendance|évolution", "trends"),
    (r"comparaison|comparer", "comparison"),
    (r"alerte|vigilance", "alerts"),
    (r"cette.*semaine", "this_week"),
    (r"ce.*mois", "this_month"),
    (r"hier", "yesterday"),
)
DEFAULT_ROUTE = "general"
DEFAULT_DAYS = 7
MAX_NUMBER = 36_500
"""A hundred years of days; larger numbers in a question are no number of days."""

# Words that pick the ranked measure and its direction.
RANKING_WORDS: tuple[tuple[tuple[str, ...], str, bool], ...] = (
    (("plus chaud", "plus chaude"), "temperature", False),
    (("plus froid", "plus froide"), "temperature", True),
    (("plus humide",), "humidite", False),
    (("plus venteux", "plus de vent"), "vitesse_vent", False),
)


# What the patterns are made of besides literal text.
_WILD = re.compile(r"\.\*|\(\[0-9\]\+\)|.\?")


def _found(text: Column, pattern: str) -> Column:
    """Whether the pattern occurs.  Plain substring tests come first: a text without
    the literal pieces of any alternative never reaches the regular expression."""
    alternatives = [
        [piece for piece in _WILD.split(alternative) if piece]
        for alternative in pattern.split("|")
    ]
    possible = reduce(
        or_, [reduce(and_, [text.contains(p) for p in pieces]) for pieces in alternatives]
    )
    # A dot stops at line feeds only, as it does for the driver.
    return possible & text.rlike(f"(?d){pattern}") if _WILD.search(pattern) else possible


def classify_question(question: Column | str) -> Column:
    """Route name of each question in a column."""
    text = F.lower(F.col(question) if isinstance(question, str) else question)
    return reduce(
        lambda rest, route: F.when(_found(text, route[0]), F.lit(route[1])).otherwise(rest),
        reversed(ROUTES),
        F.lit(DEFAULT_ROUTE),
    )


def first_number(question: Column | str, default: int = DEFAULT_DAYS) -> Column:
    """First integer written in the text; the default when there is none or it exceeds ``MAX_NUMBER``."""
    text = F.col(question) if isinstance(question, str) else question
    number = F.regexp_extract(text, r"([0-9]+)", 1).try_cast("int")
    return F.when(number <= MAX_NUMBER, number).otherwise(F.lit(default))


def route_of(question: str) -> str:
    """Driver-side twin of :func:`classify_question` for one question."""
    lowered = question.lower()
    return next((name for pattern, name in ROUTES if re.search(pattern, lowered)), DEFAULT_ROUTE)


def number_of(question: str, default: int = DEFAULT_DAYS) -> int:
    found = re.search(r"[0-9]+", question)
    number = int(found.group()) if found else default
    return number if number <= MAX_NUMBER else default


def ranking_of(question: str) -> tuple[str, bool]:
    """(measure, ascending) wanted by a ranking question; warmest first by default."""
    lowered = question.lower()
    for words, measure, ascending in RANKING_WORDS:
        if any(word in lowered for word in words):
            return measure, ascending
    return "temperature", False
