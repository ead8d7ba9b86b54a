"""Exact quantiles of large groups.

The built-in exact percentile keeps every distinct value of a group in one
buffer.  Here a sketch first brackets each wanted rank; values outside the
bracket are only counted, and those inside are counted by value.  With sketch
accuracy A a bracket holds about 10/A of the group at most (a group under A rows
is its own bracket).  The distinct values inside the brackets are cut into cells of about equal
numbers, the ranges of a range partitioning, so that an outlier empties no cell; cell totals
tell which one or two hold the rank, and only their values are ranked.  Least and greatest values are not ranked at all.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stationlab.operators.joins import is_small
from stationlab.session import checkpoint_folder

ACCURACY = 10_000
MAX_BROADCAST_GROUPS = 100_000

# output name -> (measure, share)
Wanted = dict[str, tuple[str, float]]


def _brackets(values: DataFrame, by: list[str], shares: list[float], accuracy: int) -> DataFrame:
    """Per group: its size and, for each share, a range that surely holds the rank."""
    # The sketch errs by 1/A; 4/A also leaves room for the next rank of a blend.
    margin = 4.0 / accuracy
    edges = [min(max(p + side, 0.0), 1.0) for p in shares for side in (-margin, margin)]
    sized = values.groupBy(*by).agg(
        F.count("*").alias("_n"),
        F.min("_v").alias("_min"),
        F.max("_v").alias("_max"),
        F.percentile_approx("_v", edges, accuracy).alias("_q"),
    )

    def bound(i: int) -> Column:
        extreme = F.col("_max") if i % 2 else F.col("_min")
        if edges[i] in (0.0, 1.0):
            return extreme
        return F.when(F.col("_n") <= accuracy, extreme).otherwise(F.col("_q")[i])

    ranges = [
        F.struct(
            F.lit(j).alias("_j"),
            F.lit(repr(p)).cast("decimal(20,10)").alias("_share"),
            bound(2 * j).alias("_low"),
            bound(2 * j + 1).alias("_high"),
        )
        for j, p in enumerate(shares)
    ]
    return sized.select(*by, "_n", "_min", "_max", F.array(*ranges).alias("_ranges"))


def cells_of(counted: DataFrame, spot: list[str]) -> DataFrame:
    """The values with their cell: a range of (place, value), of about as many rows as any other."""
    return counted.repartitionByRange(*spot, "_v").withColumn("_cell", F.spark_partition_id())


def exact_quantiles(
    df: DataFrame,
    wanted: Wanted,
    by: tuple[str, ...] = (),
    interpolate: bool = False,
    accuracy: int = ACCURACY,
) -> DataFrame:
    """One row per group of ``by`` with a column per entry of ``wanted``.

    Without ``interpolate`` a quantile is the smallest value whose cumulative
    share reaches p; with it, the linear blend of the two neighbouring values.
    All measures share two passes over the input.  The first runs at once: a sketch
    may differ when it is taken again, and the number of groups decides the joins.
    """
    measures = list(dict.fromkeys(m for m, _ in wanted.values()))
    extremes = {0.0: "_min", 1.0: "_max"}
    shares = sorted({p for _, p in wanted.values() if p not in extremes})
    groups = [*by, "_measure"]
    long = F.inline(
        F.array(
            *[
                F.struct(F.lit(i).alias("_measure"), F.col(m).cast("double").alias("_v"))
                for i, m in enumerate(measures)
            ]
        )
    )
    values = df.select(*by, long).filter(F.col("_v").isNotNull()).withColumn("_c", F.lit(1).cast("long"))
    checkpoint_folder(df.sparkSession)
    brackets = _brackets(values, groups, shares, accuracy).checkpoint()
    few = is_small(brackets, MAX_BROADCAST_GROUPS)
    if not few:
        # Copies of a value collapse before rows travel to their group.
        values = values.groupBy(*groups, "_v").agg(F.sum("_c").alias("_c"))

    if interpolate:
        position = F.col("_share").cast("double") * (F.col("_n") - 1).cast("double")
        first = F.floor(position) + 1
        second, part = F.least(first + 1, F.col("_n")), position - F.floor(position)
    else:
        reached = F.ceil(F.col("_n").cast("decimal(18,0)") * F.col("_share")).cast("long")
        first = second = F.greatest(reached, F.lit(1))
        part = F.lit(0.0)

    ranges = brackets.select(*groups, "_n", F.inline("_ranges")).select(
        "*", first.alias("_a"), second.alias("_b"), part.alias("_part")
    )
    packed = brackets.select(*groups, "_ranges")
    placed = values.join(F.broadcast(packed) if few else packed, groups)
    # Rows under a bracket are only counted; only those inside one become rows of it.
    under = [F.sum(F.when(F.col("_v") < F.col("_ranges")[j]["_low"], F.col("_c"))).alias(f"_u{j}") for j in range(len(shares))]
    below = F.array(*[F.struct(F.lit(j).alias("_j"), F.coalesce(f"_u{j}", F.lit(0)).alias("_under")) for j in range(len(shares))])
    below = placed.groupBy(*groups).agg(F.count("*").alias("_"), *under).select(*groups, F.inline(below)) if shares else None
    inside = F.filter("_ranges", lambda r: (F.col("_v") >= r["_low"]) & (F.col("_v") <= r["_high"]))
    spot = [*groups, "_j", "_share"]
    counted = placed.select(*groups, "_v", "_c", F.inline(inside)).groupBy(*spot, "_v").agg(F.sum("_c").alias("_c"))
    ends = brackets.select(*groups, F.lit(0.0).alias("_part"), F.inline(F.array(*[F.struct(F.lit(repr(p)).cast("decimal(20,10)").alias("_share"), F.col(c).alias("_low"), F.col(c).alias("_high")) for p, c in extremes.items()])))
    ends = ends.select(*groups, "_share", "_low", "_high", "_part")
    if shares:
        counted = cells_of(counted, spot).checkpoint()
        caught = (F.col("_last") + F.col("_under") >= F.col("_b")) & (F.col("_under") < F.col("_a"))
        along = Window.partitionBy(*spot).orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0)
        cells = (
            counted.groupBy(*spot, "_cell")
            .agg(F.sum("_c").alias("_size"))
            .withColumn("_end", F.sum("_size").over(along))
            .withColumn("_last", F.max("_end").over(Window.partitionBy(*spot)))
            .join(below, [*groups, "_j"])
            .join(ranges.select(*spot, "_a", "_b", "_part"), spot)
            # A sketch outside its promise must not end as a silent null.
            .filter(F.assert_true(caught, F.lit("a quantile lies outside its bracket")).isNull())
            .withColumn("_end", F.col("_end") + F.col("_under"))
            .filter((F.col("_end") >= F.col("_a")) & (F.col("_end") - F.col("_size") < F.col("_b")))
            .select(*spot, "_cell", (F.col("_end") - F.col("_size")).alias("_before"), "_a", "_b", "_part")
        )
        # One or two cells for each rank, so they are as few as the groups.
        in_cell = Window.partitionBy(*spot, "_cell").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
        upto = counted.join(F.broadcast(cells) if few else cells, [*spot, "_cell"]).withColumn(
            "_upto", F.col("_before") + F.sum("_c").over(in_cell)
        )
        at_ranks = upto.groupBy(*groups, "_share").agg(
            F.min(F.when(F.col("_upto") >= F.col("_a"), F.col("_v"))).alias("_low"),
            F.min(F.when(F.col("_upto") >= F.col("_b"), F.col("_v"))).alias("_high"),
            F.max("_part").alias("_part"),
        )
        at_ranks = at_ranks.union(ends)
    else:
        at_ranks = ends
    blended = F.col("_low") + (F.col("_high") - F.col("_low")) * F.col("_part")

    def cell(measure: str, share: float) -> Column:
        here = (F.col("_measure") == measures.index(measure)) & (
            F.col("_share") == F.lit(repr(share)).cast("decimal(20,10)")
        )
        return F.max(F.when(here, blended))

    return at_ranks.groupBy(*by).agg(*[cell(m, p).alias(name) for name, (m, p) in wanted.items()])


def box_stats(df: DataFrame, value: str = "temperature", by: str = "station_name") -> DataFrame:
    """Minimum, quartiles and maximum of each group."""
    marks = {"minimum": 0.0, "q1": 0.25, "mediane": 0.5, "q3": 0.75, "maximum": 1.0}
    return exact_quantiles(df, {n: (value, p) for n, p in marks.items()}, by=(by,), interpolate=True)
