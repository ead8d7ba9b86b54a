"""Percentile thresholds and the anomalies they define."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationlab.functions import is_above, is_outside, score_above, score_outside
from stationlab.operators.joins import join_checked
from stationlab.operators.quantiles import exact_quantiles

# output name -> (measure, share); fixed values
THRESHOLDS = {
    "temp_p5": ("temperature", 0.05),
    "temp_p95": ("temperature", 0.95),
    "vent_p95": ("vitesse_vent", 0.95),
    "pression_p5": ("pression", 0.05),
    "pression_p95": ("pression", 0.95),
}


def thresholds(
    df: DataFrame, by: str | None = None, exact: bool = False, accuracy: int = 10_000
) -> DataFrame:
    """One row of thresholds (or one per ``by``).

    The default is a mergeable sketch with rank error at most 1/accuracy, one
    pass and a buffer of bounded size; ``exact`` takes a second pass.
    """
    keys = [by] if by else []
    if not exact:
        sketches = [
            F.percentile_approx(measure, share, accuracy).alias(name)
            for name, (measure, share) in THRESHOLDS.items()
        ]
        return df.groupBy(*keys).agg(*sketches)

    return exact_quantiles(df, THRESHOLDS, by=tuple(keys))


def rank_errors(df: DataFrame, limits: DataFrame, tolerance: float) -> DataFrame:
    """Per threshold, whether the shares of rows below it and up to it agree with its own share within ``tolerance``.

    One pass over the measures; ``limits`` is one row.
    """
    names = list(THRESHOLDS)
    held = with_thresholds(df.select(*{m: None for m, _ in THRESHOLDS.values()}), limits)
    sums = []
    for name, (measure, _) in THRESHOLDS.items():
        x, t = F.col(measure), F.col(name)
        sums += [F.count(x).alias(f"_n_{name}"), F.count_if(x < t).alias(f"_b_{name}"), F.count_if(x <= t).alias(f"_u_{name}")]
    rows = [
        F.struct(
            F.lit(name).alias("seuil"),
            F.col(f"_n_{name}").alias("valeurs"),
            (F.col(f"_b_{name}") <= (share + tolerance) * F.col(f"_n_{name}")).alias("pas_trop_haut"),
            (F.col(f"_u_{name}") >= (share - tolerance) * F.col(f"_n_{name}")).alias("pas_trop_bas"),
        )
        for name, share in ((n, THRESHOLDS[n][1]) for n in names)
    ]
    return held.agg(*sums).select(F.inline(F.array(*rows)))


def with_thresholds(df: DataFrame, limits: DataFrame, by: str | None = None) -> DataFrame:
    """Attach thresholds to every row.

    Without ``by`` they are one row, read as a scalar subquery; with ``by`` they are
    joined, and broadcast if a count shows that they are few, so that a heavy key stays spread.
    """
    if by:
        return join_checked(df, limits, [by], "left")
    row = limits.select(F.struct(*THRESHOLDS)).scalar()
    return df.withColumn("_limits", row).select(*df.columns, "_limits.*")


def flag_anomalies(df: DataFrame, limits: DataFrame, by: str | None = None) -> DataFrame:
    """Flags and scores of each reading against given thresholds."""
    t, w, p = F.col("temperature"), F.col("vitesse_vent"), F.col("pression")
    temp = F.col("temp_p5"), F.col("temp_p95")
    pressure = F.col("pression_p5"), F.col("pression_p95")
    wind = F.col("vent_p95")
    return with_thresholds(df, limits, by).select(
        *df.columns,
        is_outside(t, *temp).alias("anomalie_temperature"),
        score_outside(t, *temp).alias("score_anomalie_temp"),
        is_above(w, wind).alias("anomalie_vent"),
        score_above(w, wind).alias("score_anomalie_vent"),
        is_outside(p, *pressure).alias("anomalie_pression"),
        score_outside(p, *pressure).alias("score_anomalie_pression"),
    )


def detect_anomalies(
    df: DataFrame, by: str | None = None, exact: bool = False, accuracy: int = 10_000
) -> DataFrame:
    """Thresholds of ``df`` itself applied to ``df``, in one lazy plan."""
    narrow = df.select(*([by] if by else []), "temperature", "vitesse_vent", "pression")
    return flag_anomalies(df, thresholds(narrow, by, exact, accuracy), by)
