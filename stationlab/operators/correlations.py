"""Weather against urban activity, period by period, from co-moments that merge.

A period is known by six numbers: the count, both means, and the sums of squares and products of distances to
the means.  Those of longer periods follow from the shorter ones', each a sum of what lies inside the parts and
between their means: readings are aggregated once, and a stored table of daily co-moments gives months and years
without reading them again.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stationlab.schemas import CORRELATIONS

MOMENTS = ("n", "mx", "my", "cxx", "cyy", "cxy")
PLACE = ("zone", "variable_meteo", "variable_urbaine")
FLAT = 1e-9
"""A correlation this near to one has no significance: its t would be noise."""


def comoments(
    readings: DataFrame,
    events: DataFrame,
    measure: str = "temperature",
    zone: str = "station",
    kind: str = "type_evenement",
    step: str = "hour",
    period: str = "day",
) -> DataFrame:
    """Co-moments of the mean measure and the number of events of a kind, step by step, per (zone, kind, period).

    A step counts where there is a known reading; one without events of a kind counts zero, in each period that has some
    of the kind.  Both sides shrink to a row per zone and step (and kind) before they meet.  Rows without zone,
    time or kind take no part.
    """
    x = F.when(F.abs(measure) < float("inf"), F.col(measure))
    weather = readings.filter(x.isNotNull() & F.col("timestamp").isNotNull()).groupBy(F.col(zone).alias("zone"), F.date_trunc(step, "timestamp").alias("_at"))
    weather = weather.agg(F.avg(x).alias("_x")).withColumn("timestamp", F.date_trunc(period, "_at"))
    urban = events.filter(F.col("debut").isNotNull() & F.col(kind).isNotNull())
    urban = urban.groupBy(F.col(zone).alias("zone"), F.col(kind).alias("variable_urbaine"), F.date_trunc(step, "debut").alias("_at"))
    urban = urban.agg(F.count("*").alias("_y"))
    kinds = urban.select("zone", "variable_urbaine", F.date_trunc(period, "_at").alias("timestamp")).distinct()
    steps = weather.join(kinds, ["zone", "timestamp"]).join(urban, ["zone", "variable_urbaine", "_at"], "left")
    y = F.coalesce("_y", F.lit(0)).cast("double")
    n = F.count("*")
    return (
        steps.groupBy("timestamp", "zone", F.lit(measure).alias("variable_meteo"), "variable_urbaine")
        .agg(
            n.alias("n"),
            F.avg("_x").alias("mx"),
            F.avg(y).alias("my"),
            (F.var_pop("_x") * n).alias("cxx"),
            (F.var_pop(y) * n).alias("cyy"),
            (F.covar_pop("_x", y) * n).alias("cxy"),
        )
        .withColumn("periode_analyse", F.lit(period))
    )


def merged(moments: DataFrame, period: str) -> DataFrame:
    """Co-moments of longer periods from those of their parts."""
    place = ["_period", *PLACE]
    whole = Window.partitionBy(*place)
    n = F.sum("n").over(whole)
    parts = moments.withColumn("_period", F.date_trunc(period, "timestamp"))
    parts = parts.withColumns({"_mx": F.sum(F.col("n") * F.col("mx")).over(whole) / n, "_my": F.sum(F.col("n") * F.col("my")).over(whole) / n})
    dx, dy = F.col("mx") - F.col("_mx"), F.col("my") - F.col("_my")
    return (
        parts.groupBy(*place)
        .agg(
            F.sum("n").alias("n"),
            F.first("_mx").alias("mx"),
            F.first("_my").alias("my"),
            F.sum(F.col("cxx") + F.col("n") * dx * dx).alias("cxx"),
            F.sum(F.col("cyy") + F.col("n") * dy * dy).alias("cyy"),
            F.sum(F.col("cxy") + F.col("n") * dx * dy).alias("cxy"),
        )
        .withColumnRenamed("_period", "timestamp")
        .withColumn("periode_analyse", F.lit(period))
    )


def correlations(moments: DataFrame) -> DataFrame:
    """The declared rows: Pearson's r and its t = r sqrt((n - 2) / (1 - r^2)); null where a side does not vary."""
    r = F.col("cxy") / F.sqrt(F.col("cxx")) / F.sqrt(F.col("cyy"))
    r = F.when((F.col("cxx") > 0) & (F.col("cyy") > 0), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))
    rows = moments.withColumns({"type_correlation": F.lit("pearson"), "valeur_correlation": r})
    r = F.col("valeur_correlation")
    t = F.when((F.col("n") > 2) & (1 - r * r > FLAT), r * F.sqrt((F.col("n") - 2) / (1 - r * r)))
    rows = rows.withColumns({"significativite": t, "timestamp": F.col("timestamp").cast("timestamp")})
    return rows.select(*[F.col(f.name).cast(f.dataType) for f in CORRELATIONS.fields])
