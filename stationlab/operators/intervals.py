"""Readings that fall inside events: pairs, or figures per event."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stationlab.operators.blocks import micros
from stationlab.operators.joins import MAX_BROADCAST_ROWS
from stationlab.session import checkpoint_folder

BITS = 4
"""A bucket is 2^BITS buckets of the width below."""
BASE = 32
FINE = tuple(range(0, BASE, BITS))
"""Widths of buckets, as powers of two microseconds: about an hour, and within it."""
FAR = 1 << 56
"""The end of an event without one: beyond all times that can be written."""


def _bucket(ts: Column, seconds: int) -> Column:
    return F.floor(F.unix_seconds(ts.cast("timestamp")) / seconds).cast("long")


def associate(
    readings: DataFrame,
    events: DataFrame,
    zone: str = "station",
    bucket_seconds: int = 3600,
) -> DataFrame:
    """Pairs of an event and a reading of its zone with ``debut <= timestamp < fin``.

    An open event reaches to the newest reading.  Both sides meet on
    (zone, time bucket), so the plan is an equi-join whose heavy buckets adaptive
    execution can split.  The result is as large as the pairs are many; for
    figures per event use :func:`event_stats`, which forms no pairs.
    Apart from ``zone`` the two sides must not share column names.
    """
    span = readings.agg(F.min("timestamp").alias("_from"), F.max("timestamp").alias("_to"))
    # Only the part of an event that readings cover is spread over buckets.
    covered = (
        events.withColumn("_span", span.select(F.struct("_from", "_to")).scalar())
        .withColumn("_start", F.greatest("debut", "_span._from"))
        .withColumn("_stop", F.coalesce(F.least("fin", "_span._to"), F.col("_span._to")))
        .filter(F.col("_start") <= F.col("_stop"))
    )
    buckets = F.sequence(
        _bucket(F.col("_start"), bucket_seconds), _bucket(F.col("_stop"), bucket_seconds)
    )
    spread = covered.withColumn("_bucket", F.explode(buckets)).drop("_span", "_start", "_stop")
    placed = readings.withColumn("_bucket", _bucket(F.col("timestamp"), bucket_seconds))
    inside = (F.col("timestamp") >= F.col("debut")) & (
        F.col("fin").isNull() | (F.col("timestamp") < F.col("fin"))
    )
    return placed.join(spread, [zone, "_bucket"]).filter(inside).drop("_bucket")


def _whole_buckets(hours: DataFrame, spans: DataFrame) -> DataFrame:
    """Counts and means of whole buckets: ``spans`` (_zone, _event, _i, _j) take those from ``_i`` to ``_j``, both included.

    ``hours`` hold the counts and means of a zone's buckets (_at).  The highest bit in which the two ends differ parts a span
    at one place: the end of an aligned stretch of buckets, which it asks from ``_i`` on, and the start of the next, up to ``_j``.
    Each is a running aggregate over a stretch.  Equal questions are answered once, so no more than twice the buckets
    a level whatever the spans; a span costs two rows.
    """
    spans = spans.filter("_i <= _j").withColumn("_level", F.length(F.bin(F.col("_i").bitwiseXOR(F.col("_j")))) - 1)
    side = lambda at, side: F.struct(F.col(at).alias("_at"), F.lit(side).alias("_side"))
    right = F.array(side("_j", 1))
    sides = F.when(F.col("_i") < F.col("_j"), F.array(side("_j", 1), side("_i", -1))).otherwise(right)
    asks = spans.select("_zone", "_event", "_level", F.inline(sides))
    stretch = "shiftright(_at, _level) AS _stretch"
    asked = asks.select("_zone", "_level", "_at", "_side").distinct().checkpoint()
    spots = asked.selectExpr("_zone AS _of", "_level AS _l", stretch).distinct().withColumnRenamed("_stretch", "_s")
    found = {r["_level"]: r["count"] for r in asked.groupBy("_level").count().collect()}
    few = sum(found.values()) <= MAX_BROADCAST_ROWS
    levels = F.array(*[F.lit(k) for k in sorted(found)]).cast("array<int>")
    totals = hours.withColumn("_level", F.explode(levels)).selectExpr("*", stretch)
    same = F.col("_zone").eqNullSafe(F.col("_of")) & (F.col("_level") == F.col("_l")) & (F.col("_stretch") == F.col("_s"))
    line = totals.join(F.broadcast(spots) if few else spots, same, "left_semi").withColumn("_side", F.lit(0))
    line = line.unionByName(asked.selectExpr("*", stretch), allowMissingColumns=True)
    stretches = Window.partitionBy("_zone", "_level", "_stretch")
    figures = {}
    for k, order in ((1, F.asc("_at")), (-1, F.desc("_at"))):
        upto = stretches.orderBy(order).rangeBetween(Window.unboundedPreceding, 0)
        figures[k] = [F.sum("_n").over(upto), F.sum("_k").over(upto), F.sum(F.when(F.col("_k") > 0, F.col("_mean") * F.col("_k"))).over(upto)]
    line = line.withColumns({f"_{k}_{i}".replace("-", "m"): figures[k][i] for k in (1, -1) for i in range(3)}).filter("_side <> 0")
    of = lambda i: F.when(F.col("_side") == 1, F.col(f"_1_{i}")).otherwise(F.col(f"_m1_{i}"))
    answers = line.select(
        F.col("_zone").alias("_of"), F.col("_level").alias("_l"), F.col("_at").alias("_a"), F.col("_side").alias("_s"),
        of(0).alias("_n"), of(1).alias("_k"), F.when(of(1) > 0, of(2) / of(1)).alias("_mean"),
    ).filter("_n > 0")
    same = F.col("_zone").eqNullSafe(F.col("_of")) & (F.col("_level") == F.col("_l")) & (F.col("_at") == F.col("_a")) & (F.col("_side") == F.col("_s"))
    return asks.join(F.broadcast(answers) if few else answers, same).select("_event", "_n", "_k", "_mean")


def _mean() -> Column:
    """The mean of several sets of values from their counts and means."""
    weighed = F.sum(F.when(F.col("_k") > 0, F.col("_mean") * F.col("_k")))
    return F.when(F.sum("_k") > 0, weighed / F.sum("_k")).alias("_mean")


def event_stats(
    readings: DataFrame,
    events: DataFrame,
    event_id: str,
    measure: str = "temperature",
    zone: str = "station",
) -> DataFrame:
    """Per event: number of readings inside it and the mean of their measure.

    An event that begins and ends in different buckets of 2^32 microseconds (72 minutes) is the end of the one, the start of the
    other, and the whole buckets between.  One that lies in a single bucket is looked at sixteen, 256, ...
    times closer, until it begins and ends in different ones.  Ends and starts are running aggregates from the bucket's
    edge, whole buckets running aggregates of counts and means; what an event does not cover has no part in its figures.  An
    event costs two questions to each (between closer buckets up to fourteen joined); readings are looked at closer only
    where some event asks.

    Not-a-number and infinities count as missing.  Events without readings, or without a start, have count 0; an event that
    ends before it starts has no row; rows of one id are added up.
    """
    x = F.when(F.abs(measure) < float("inf"), F.col(measure).cast("double"))
    checkpoint_folder(readings.sparkSession)
    rows = readings.select(F.col(zone).alias("_zone"), micros("timestamp").alias("_at"), x.alias("_x")).filter("_at is not null")
    proper = F.col("fin").isNull() | (F.col("fin") >= F.col("debut"))
    events = events.filter(proper).select(
        F.col(zone).alias("_zone"), F.col(event_id).alias("_event"), micros("debut").alias("_a"), F.coalesce(micros("fin"), F.lit(FAR)).alias("_b")
    )
    base = BASE
    apart = F.lit(0)
    for shift in (*FINE[1:], base):  # the widest buckets that the two ends do not share
        apart = F.when(F.shiftright("_a", shift) != F.shiftright("_b", shift), shift).otherwise(apart)
    some = events.filter("_a < _b").withColumn("_shift", apart)
    some = some.selectExpr("*", "shiftright(_a, _shift) AS _first", "shiftright(_b, _shift) AS _last")

    # Ends and starts: questions on the line of a bucket, before the readings of their instant.
    edge = lambda bucket, at, kind: F.struct(F.col(bucket).alias("_bucket"), (F.col(at) * 2).alias("_us"), F.lit(kind).alias("_kind"))
    asks = some.select("_zone", "_event", "_shift", F.inline(F.array(edge("_first", "_a", -1), edge("_last", "_b", 1))))
    line = _looked_at(rows, asks).select(
        "_zone", "_shift", "_bucket", (F.col("_at") * 2 + 1).alias("_us"), F.lit(0).alias("_kind"), "_x"
    )
    line = line.unionByName(asks, allowMissingColumns=True)
    bucket = Window.partitionBy("_zone", "_shift", "_bucket")
    figures = {}
    for side, order in ((1, F.asc("_us")), (-1, F.desc("_us"))):
        upto = bucket.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        here = F.count(F.when(F.col("_kind") == 0, 1)), F.count("_x"), F.avg("_x")
        figures[side] = [c.over(upto) for c in here]
    asked = line.withColumns({f"_{n}{i}": figures[side][i] for side, n in ((1, "s"), (-1, "e")) for i in range(3)}).filter("_kind <> 0")
    of = lambda i: F.when(F.col("_kind") == 1, F.col(f"_s{i}")).otherwise(F.col(f"_e{i}"))
    ends = asked.select("_event", of(0).alias("_n"), of(1).alias("_k"), of(2).alias("_mean"))

    # Whole buckets between: those of all readings, closer ones where asked.
    known = F.count("*").alias("_n"), F.count("_x").alias("_k"), F.avg("_x").alias("_mean")
    hours = rows.groupBy("_zone", F.shiftright("_at", base).alias("_at")).agg(*known)
    far = some.filter(F.col("_shift") == base).select("_zone", "_event", (F.col("_first") + 1).alias("_i"), (F.col("_last") - 1).alias("_j"))
    near = some.filter((F.col("_shift") < base) & (F.col("_last") - F.col("_first") > 1))
    near = near.select("_zone", "_event", "_shift", F.explode(F.sequence(F.col("_first") + 1, F.col("_last") - 1)).alias("_bucket"))
    narrow = _looked_at(rows, near).groupBy("_zone", "_shift", "_bucket").agg(*known)
    narrow = narrow.withColumnRenamed("_zone", "_of")
    same = near["_zone"].eqNullSafe(narrow["_of"]) & (near["_shift"] == narrow["_shift"]) & (near["_bucket"] == narrow["_bucket"])
    between = _whole_buckets(hours, far), near.join(narrow, same).select("_event", "_n", "_k", "_mean")
    none = events.select("_event", F.lit(0).cast("long"), F.lit(0).cast("long"), F.lit(None).cast("double"))
    found = ends.union(between[0]).union(between[1]).union(none).groupBy("_event")
    found = found.agg(F.sum("_n").alias("nb_mesures"), _mean().alias("moyenne"))
    return found.select(F.col("_event").alias(event_id), "nb_mesures", "moyenne")


def _looked_at(rows: DataFrame, asks: DataFrame) -> DataFrame:
    """The readings in the buckets that are asked for, once for each width at which they are.

    Only widths that some event asks for are looked at; the buckets are counted, and broadcast if they are few.
    """
    spots = asks.select(F.col("_zone").alias("_of"), F.col("_shift").alias("_s"), F.col("_bucket").alias("_b")).distinct()
    found = {r["_s"]: r["count"] for r in spots.groupBy("_s").count().collect()}
    shifts = F.array(*[F.lit(k) for k in sorted(found)]).cast("array<int>")
    levels = rows.withColumn("_shift", F.explode(shifts)).selectExpr("*", "shiftright(_at, _shift) AS _bucket")
    same = F.col("_zone").eqNullSafe(F.col("_of")) & (F.col("_shift") == F.col("_s")) & (F.col("_bucket") == F.col("_b"))
    few = sum(found.values()) <= MAX_BROADCAST_ROWS
    return levels.join(F.broadcast(spots) if few else spots, same, "left_semi")
