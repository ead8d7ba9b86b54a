"""Rolling means, volatility and trends per station.

A frame of k rows costs k updates per row when the engine recomputes it, and totals of
what enters less what leaves keep a residue of every extreme value for ever.  Here a
station's line is cut into chunks as long as the frame.  A frame is then the head of its
own chunk and the tail of the chunk before, each a running aggregate (one forwards, one
backwards), merged pairwise: constant work per row, and nothing outside a frame has any
part in its figures.  Frames of rows are reckoned on the columns of a block of a station
(see ``frames``); stations too heavy for one task are cut into several blocks (see ``blocks``).
Frames of time are cut at granules instead (see ``rolling_time``).
"""

import math

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stationlab.operators.blocks import BLOCK_ROWS, Blocks, micros, ordered, plan_blocks
from stationlab.operators.frames import rolling
from stationlab.operators.joins import join_checked, join_checked_on
from stationlab.session import checkpoint_folder

# Rows before the current one (fixed values): 7 days, 30 days, 24 h of hourly rows.
ROWS_7D, ROWS_30D, ROWS_24H = 168, 720, 24
WORKER_ROWS, WORKER_HALOS = 50_000, 20
"""A worker holds a block's columns several times over: no more rows than this, or than so many halos."""
HOUR = 3_600_000_000
DAY = 24 * HOUR

Names = tuple[str, str]
METRIC_NAMES: tuple[Names, Names] = (
    ("temp_moy_7j", "temp_volatilite_7j"),
    ("temp_moy_30j", "temp_volatilite_30j"),
)
TREND = "temp_tendance_24h"


def _finite(x: Column) -> Column:
    """Not-a-number and infinities count as missing: they would poison a running total."""
    return F.when(F.abs(x) < float("inf"), x)


PARTS = ("n", "s", "v", "low", "high")


def _aggregate(x: Column, over, name: str) -> dict[str, Column]:
    """What a head or a tail is known by; the engine updates all of them row by row."""
    return {
        f"{name}n": F.count(x).over(over),
        f"{name}s": F.sum(x).over(over),
        f"{name}v": F.var_pop(x).over(over) * F.count(x).over(over),
        f"{name}low": F.min(x).over(over),
        f"{name}high": F.max(x).over(over),
    }


def _merged(a: dict[str, Column], b: dict[str, Column]) -> dict[str, Column]:
    """The aggregate of both sets of values; either may be empty, its parts null or zero."""
    n1, n2 = (F.coalesce(p["n"], F.lit(0).cast("long")) for p in (a, b))
    n = n1 + n2
    gap = b["s"] / n2 - a["s"] / n1
    between = F.coalesce(gap * gap * n1 * n2 / n, F.lit(0.0))
    return {
        "n": n,
        "s": F.when(n1 == 0, b["s"]).when(n2 == 0, a["s"]).otherwise(a["s"] + b["s"]),
        "v": F.coalesce(a["v"], F.lit(0.0)) + F.coalesce(b["v"], F.lit(0.0)) + F.when((n1 > 0) & (n2 > 0), between).otherwise(0.0),
        "low": F.least(a["low"], b["low"]),
        "high": F.greatest(a["high"], b["high"]),
    }


def _figures(whole: dict[str, Column], names: Names) -> list[Column]:
    """Mean and sample deviation; equal values have exactly their own mean and no deviation."""
    n, constant = whole["n"], whole["low"] == whole["high"]
    mean = F.when(constant, whole["low"]).when(n > 0, whole["s"] / n)
    deviation = F.when(n > 1, F.when(constant, 0.0).otherwise(F.sqrt(whole["v"] / (n - 1))))
    return [mean.alias(names[0]), deviation.alias(names[1])]


def _columns(name: str) -> dict[str, Column]:
    return {p: F.col(f"{name}{p}") for p in PARTS}


def rolling_rows(
    df: DataFrame,
    value: str,
    frames: dict[int, Names],
    lags: dict[int, str] | None = None,
    key: str = "station",
    ts: str = "timestamp",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Mean and sample deviation over the current row and ``rows`` rows before it.

    ``frames`` maps rows to the two output names; ``lags`` maps an offset to the
    name of (value - value that many rows earlier).  Rows of one (key, time) are
    ordered by a hash of the row.
    """
    lags = lags or {}
    halo = max([*frames, *lags], default=0) + 1
    block_rows = min(block_rows, max(WORKER_ROWS, WORKER_HALOS * halo))
    in_order = ordered(df, ts)
    blocks = plan_blocks(in_order, halo, key, block_rows).place(in_order)
    schema = T.StructType(
        [
            *blocks.schema.fields,
            *[T.StructField(n, T.DoubleType()) for names in frames.values() for n in names],
            *[T.StructField(n, blocks.schema[value].dataType) for n in lags.values()],
        ]
    )

    def roll(table: pa.Table) -> pa.Table:
        table = table.sort_by([("_us", "ascending"), ("_tie", "ascending")])
        own = table.column(value).combine_chunks()
        line = own.cast(pa.float64()).to_numpy(zero_copy_only=False)
        for rows, names in frames.items():
            for name, found in zip(names, rolling(line, rows)):
                table = table.append_column(name, pa.array(found, pa.float64(), from_pandas=True))
        for k, name in lags.items():
            none = pa.nulls(min(k, len(own)), own.type)
            earlier = pa.concat_arrays([none, own.slice(0, max(0, len(own) - k))])
            table = table.append_column(name, pc.subtract(own, earlier))
        return table

    # A block is bounded, and goes to one worker as columns.
    work = blocks.groupBy(key, "_block").applyInArrow(roll, schema)
    names = [n for pair in frames.values() for n in pair]
    return work.filter(~F.col("_halo")).select(*df.columns, *names, *lags.values())


def carry_over(placed: DataFrame, events: DataFrame, blocks: Blocks, merge: dict) -> DataFrame:
    """Add to every placed row, as ``<name>_before``, what earlier blocks of its key hold.

    ``events`` are the same rows from a narrow plan, all of them.  Only blocks after a key's first
    are listed, about rows / block_rows of them.
    """
    key = blocks.key
    earlier = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        blocks.place(blocks.heavy(events))
        .groupBy(key, "_block")
        .agg(*[f(name).alias(name) for name, f in merge.items()])
        .select(
            key,
            "_block",
            *[f(name).over(earlier).alias(f"{name}_before") for name, f in merge.items()],
        )
        .filter(F.col("_block") > 0)
        .checkpoint()
    )
    return join_checked(placed, before, [key, "_block"], "left")


def _earlier_blocks(placed: DataFrame, events: DataFrame, blocks: Blocks) -> DataFrame:
    """Add to placed events, as ``_past_<part>``, the aggregate of the earlier blocks of their line.

    Block means are taken as distances to the first block's, which every later row looks back to.
    """
    x = F.col("_x")
    order = Window.partitionBy("_line").orderBy("_block")
    past = order.rowsBetween(Window.unboundedPreceding, -1)
    sizes = (
        blocks.place(blocks.heavy(events))
        .groupBy("_line", "_block")
        .agg(
            F.count(x).alias("n"),
            F.sum(x).alias("s"),
            (F.var_pop(x) * F.count(x)).alias("v"),
            F.min(x).alias("low"),
            F.max(x).alias("high"),
        )
        .withColumn("_mean", F.col("s") / F.when(F.col("n") > 0, F.col("n")))
        .withColumn("_d", F.col("_mean") - F.first("_mean", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_nd", F.col("n") * F.col("_d"))
    )
    n, nd, ndd = F.sum("n").over(past), F.sum("_nd").over(past), F.sum(F.col("_nd") * F.col("_d")).over(past)
    before = (
        sizes.select(
            "_line",
            "_block",
            n.alias("_past_n"),
            F.sum("s").over(past).alias("_past_s"),
            (F.sum("v").over(past) + F.greatest(ndd - nd * nd / F.when(n > 0, n), F.lit(0.0))).alias("_past_v"),
            F.min("low").over(past).alias("_past_low"),
            F.max("high").over(past).alias("_past_high"),
        )
        .filter(F.col("_block") > 0)
        .checkpoint()
    )
    return join_checked(placed, before, ["_line", "_block"], "left")


GRANULES = 64
"""A frame of more granules than this is built along the line instead."""
TASK_EVENTS = 250_000
"""Events of granules that a task sorts, or one granule."""
_MARK = "struct<at:bigint,value:double>"


def _parts(x: Column) -> Column:
    """The aggregate of a group's values, as a struct."""
    values = F.count(x), F.sum(x), F.var_pop(x) * F.count(x), F.min(x), F.max(x)
    return F.struct(*[v.alias(p) for v, p in zip(values, PARTS)])


def _weighed(df: DataFrame, on: Column, over, name: str) -> DataFrame:
    """As ``_aggregate``, of points that are aggregates themselves.

    Means are taken as distances to that of the first point, which every later frame holds.
    """
    n, mean = F.when(on, F.col("_p.n")), F.when(on & (F.col("_p.n") > 0), F.col("_p.s") / F.col("_p.n"))
    df = df.withColumn(f"{name}d", mean - F.first(mean, ignorenulls=True).over(over))
    d = F.col(f"{name}d")
    total, nd, ndd = F.sum(n).over(over), F.sum(n * d).over(over), F.sum(n * d * d).over(over)
    between = F.greatest(F.coalesce(ndd - nd * nd / F.when(total > 0, total), F.lit(0.0)), F.lit(0.0))
    return df.withColumns(
        {
            f"{name}n": F.coalesce(total, F.lit(0)),
            f"{name}s": F.sum(F.when(on, F.col("_p.s"))).over(over),
            f"{name}v": F.sum(F.when(on, F.col("_p.v"))).over(over) + between,
            f"{name}low": F.min(F.when(on, F.col("_p.low"))).over(over),
            f"{name}high": F.max(F.when(on, F.col("_p.high"))).over(over),
        }
    )


def _by_granules(
    points: DataFrame, whole: DataFrame, frames: dict[int, Names], trend: tuple[int, int, str] | None, granule: int, weighed: bool, count: int
) -> DataFrame:
    """The figures of points (_key, _at, _x or _p, _mark, _row): _row's fields, the figures and, with ``trend``, _latest.

    ``whole`` holds a row per (_key, _g) with points: _whole and _mark, the aggregate of all and the latest.
    ``count`` points go to as many tasks as they need: they take little room while they travel, and much more while sorted.
    """
    line = Window.partitionBy("_key").orderBy("_g")
    empty = {p: F.lit(None).cast("double") for p in PARTS} | {"n": F.lit(0).cast("long")}
    none = F.struct(*[empty[p].alias(p) for p in PARTS])
    spans = list(frames)

    def joined(span: int) -> Column:
        """The aggregate of the whole granules between the two ends of a frame."""
        k = span // granule - 1
        if k < 1:
            return none
        some = F.collect_list("_whole").over(line.rangeBetween(-k, -1))
        merge = lambda a, b: F.struct(*[c.alias(p) for p, c in _merged(*({p: y[p] for p in PARTS} for y in (a, b))).items()])
        return F.aggregate(some, none, merge)

    nothing = F.lit(None).cast(_MARK)
    older = nothing
    if trend:
        near, far = trend[0] // granule, -(-trend[1] // granule)
        older = F.max("_mark").over(line.rangeBetween(-far, -near - 1)) if far > near else nothing
    between = whole.select(
        "_key",
        "_g",
        F.lit(-1).cast("long").alias("_u"),
        F.lit(-1).alias("_kind"),
        F.struct(*[joined(s).alias(f"m{i}") for i, s in enumerate(spans)], older.alias("older")).alias("_between"),
    )
    at, held = F.col("_at"), "_p" if weighed else "_x"
    g = F.floor(at / granule).cast("long")
    value, mark = F.col(held), F.col("_mark")
    own, copied = 0, 1 + len(spans)

    def event(later: int, kind: int, keeps_value: bool, keeps_mark: bool, keeps_row: bool) -> Column:
        def kept(column: Column, keeps: bool) -> Column:
            return column if keeps else F.when(F.lit(False), column)

        return F.struct(
            (g + later // granule).alias("_g"),
            (at - g * granule).alias("_u"),
            F.lit(kind).alias("_kind"),
            kept(value, keeps_value).alias(held),
            kept(mark, keeps_mark).alias("_last"),
            kept(F.col("_row"), keeps_row).alias("_row"),
        )

    events = [event(0, own, True, False, True)] + [event(s, 1 + i, True, False, False) for i, s in enumerate(spans)]
    if trend:
        events.append(event(trend[0], copied, False, True, False))
    work = points.select("_key", F.inline(F.array(*events))).unionByName(between, allowMissingColumns=True)
    tasks = -(-count * len(events) // TASK_EVENTS)
    work = work.repartition(tasks, "_key", "_g") if tasks > 1 else work
    granules = Window.partitionBy("_key", "_g")
    upto = granules.orderBy("_u").rangeBetween(Window.unboundedPreceding, 0)
    since = granules.orderBy(F.desc("_u")).rangeBetween(Window.unboundedPreceding, 0)

    def total(df: DataFrame, kind: int, over, name: str) -> DataFrame:
        on = F.col("_kind") == kind
        return _weighed(df, on, over, name) if weighed else df.withColumns(_aggregate(F.when(on, F.col("_x")), over, name))

    work = work.withColumns({"_past": F.max("_last").over(upto), "_whole": F.max("_between").over(upto)})
    work = total(work, own, upto, "_head_").filter(F.col("_kind") >= own)
    for i in range(len(spans)):
        work = total(work, 1 + i, since, f"_tail_{i}_")
    work = work.filter(F.col("_kind") == own)
    figures = []
    for i, span in enumerate(spans):
        middle = {p: F.col(f"_whole.m{i}.{p}") for p in PARTS}
        figures += _figures(_merged(_merged(_columns(f"_tail_{i}_"), middle), _columns("_head_")), frames[span])
    return work.select("_row.*", *figures, F.coalesce("_past", "_whole.older").alias("_latest"))


def rolling_time(
    df: DataFrame,
    value: str,
    frames: dict[int, Names],
    trend: tuple[int, int, str] | None = None,
    key: str = "station",
    ts: str = "timestamp",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Mean and sample deviation over the rows of the last ``span`` microseconds.

    A frame is closed on both ends and includes rows of the same time.
    ``trend`` = (lag, limit, name) adds value - the value of the latest row that is
    between ``lag`` and ``limit`` microseconds old.

    Time is cut into granules that divide every span and the lag (days, for the metrics).  A frame is the end of the
    granule it begins in, whole granules, and the start of its own granule.  Each row is copied, narrowed to time
    and value, to the granules one span and one lag later, so that all a granule needs meets in one exchange; whole
    granules come as one row each.

    Where a granule of some key holds more than ``block_rows`` rows, those of one instant are first combined, before
    they travel, and the figures of instants are joined to the rows: rows of one instant have the same frame.  Where
    even the instants are too many, ``rolling_along`` cuts the line into blocks.  The result is the same.
    """
    granule = math.gcd(*frames, *([trend[0]] if trend else []))
    most = max([*frames, *([trend[1]] if trend else [])], default=0)
    if not granule or most // granule > GRANULES:
        return rolling_along(df, value, frames, trend, key, ts, block_rows)
    checkpoint_folder(df.sparkSession)
    at, x = micros(ts), _finite(F.col(value))
    mark = F.struct(at.alias("at"), F.col(value).cast("double").alias("value"))
    g = F.floor(F.col("_at") / granule).cast("long").alias("_g")
    names = [n for pair in frames.values() for n in pair]
    rows = df.select(F.col(key).alias("_key"), at.alias("_at"), x.alias("_x"), mark.alias("_mark"))
    whole = rows.groupBy("_key", g).agg(F.count("*").alias("_rows"), _parts(F.col("_x")).alias("_whole"), F.max("_mark").alias("_mark"))
    whole = whole.checkpoint()
    most_rows, count = (x or 0 for x in whole.agg(F.max("_rows"), F.sum("_rows")).first())
    if most_rows <= block_rows:
        points = df.select(F.col(key).alias("_key"), at.alias("_at"), x.alias("_x"), mark.alias("_mark"), F.struct(*df.columns).alias("_row"))
        found = _by_granules(points, whole, frames, trend, granule, False, count)
    else:
        points = rows.groupBy("_key", "_at").agg(_parts(F.col("_x")).alias("_p"), F.max("_mark").alias("_mark")).checkpoint()
        if not points.groupBy("_key", g).count().filter(F.col("count") > block_rows).isEmpty():
            return rolling_along(df, value, frames, trend, key, ts, block_rows)
        instants = _by_granules(points.withColumn("_row", F.struct("_key", "_at")), whole, frames, trend, granule, True, points.count())
        instants = instants.select(F.col("_key").alias("_of"), F.col("_at").alias("_when"), *names, "_latest").checkpoint()
        found = join_checked_on(df, instants, df[key].eqNullSafe(instants["_of"]) & at.eqNullSafe(instants["_when"]))
    if not trend:
        return found.select(*df.columns, *names)
    lag, limit, name = trend
    recent = F.col("_latest.at") >= at - limit
    return found.select(*df.columns, *names, F.when(recent, F.col(value) - F.col("_latest.value")).alias(name))


def rolling_along(
    df: DataFrame,
    value: str,
    frames: dict[int, Names],
    trend: tuple[int, int, str] | None = None,
    key: str = "station",
    ts: str = "timestamp",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """The figures of ``rolling_time`` for any spans, and for crowds of rows at one time.

    Chunks are as long as the frame: a row asks its own chunk, forwards, for what came up to it, and the chunk
    before, backwards, for what is no older than the span.  Each (key, chunk) is a line of
    its own, and lines of more than ``block_rows`` events are cut into blocks, down to parts of one
    instant, that take over the aggregates of the blocks before them.
    """
    work = df.select(
        F.col(key).alias("_key"),
        micros(ts).alias("_at"),
        F.xxhash64(*df.columns).alias("_hash"),
        _finite(F.col(value)).alias("_x"),
        F.col(value).alias("_value"),
        F.struct(*df.columns).alias("_row"),
    )
    at = F.col("_at")

    def event(chunk: Column, us: Column, kind: int, x: Column | None = None, mark: Column | None = None, row: Column | None = None):
        """What happens on a line: a value or a mark comes in, or a row asks for all so far."""
        return F.struct(
            F.struct("_key", chunk.alias("chunk")).alias("_line"),
            us.alias("_us"),
            F.xxhash64("_hash", F.lit(kind)).alias("_tie"),
            (F.lit(None).cast("double") if x is None else x).alias("_x"),
            (F.lit(None).cast("struct<at:bigint,value:double>") if mark is None else mark).alias("_mark"),
            (F.lit(None).cast(carried) if row is None else row).alias("_carried"),
        )

    def played(comes: list[Column], asks: Column, total) -> DataFrame:
        """The events on their lines, with ``total`` of them; only those that ask are left."""
        events = work.select(F.inline(F.array(*comes, asks)))
        narrow = events.drop("_carried")
        blocks = plan_blocks(narrow, 0, "_line", block_rows)
        placed = blocks.place(events)
        line = Window.partitionBy("_line", "_block").orderBy("_us", "_tie")
        placed, added = total(placed, narrow, blocks, line.rowsBetween(Window.unboundedPreceding, 0))
        asked = placed.filter(F.col("_carried").isNotNull()).select("_carried.*", *added)
        # Placing reads its input several times; the passes must not multiply.
        return asked.checkpoint()

    def aggregated(name: str):
        def total(placed: DataFrame, narrow: DataFrame, blocks: Blocks, upto):
            placed = placed.withColumns(_aggregate(F.col("_x"), upto, "_here_"))
            here = _columns("_here_")
            if blocks.cut:
                placed = _earlier_blocks(placed, narrow, blocks)
                here = _merged(_columns("_past_"), here)
            return placed, [here[p].alias(f"{name}{p}") for p in PARTS]

        return total

    def latest(placed: DataFrame, narrow: DataFrame, blocks: Blocks, upto):
        placed = placed.withColumn("_here", F.max("_mark").over(upto))
        if not blocks.cut:
            return placed, [F.col("_here").alias("_latest")]
        placed = carry_over(placed, narrow, blocks, {"_mark": F.max})
        return placed, [F.coalesce("_here", "_mark_before").alias("_latest")]

    for span in frames:
        chunk, x = F.floor(at / span), F.col("_x")
        carried = work.select(F.struct("*").alias("_")).schema["_"].dataType
        row = F.struct(*work.columns)
        work = played([event(chunk, at * 2, 0, x)], event(chunk, at * 2 + 1, 1, row=row), aggregated(f"_head_{span}_"))
        carried = work.select(F.struct("*").alias("_")).schema["_"].dataType
        row = F.struct(*work.columns)
        work = played([event(chunk, -at * 2, 0, x)], event(chunk - 1, (span - at) * 2 + 1, 1, row=row), aggregated(f"_tail_{span}_"))
    results = []
    if trend:
        lag, limit, name = trend
        # The latest row so old is in the asked chunk or, at its end, in the one before.
        mark = F.struct(at.alias("at"), F.col("_value").cast("double").alias("value"))
        carried = work.select(F.struct("*").alias("_")).schema["_"].dataType
        chunk, row = F.floor(at / limit), F.struct(*work.columns)
        comes = [event(chunk, at * 2, 0, mark=mark), event(chunk + 1, at * 2, 2, mark=mark)]
        work = played(comes, event(F.floor((at - lag) / limit), (at - lag) * 2 + 1, 1, row=row), latest)
        recent = F.col("_latest.at") >= at - limit
        results = [F.when(recent, F.col("_value") - F.col("_latest.value")).alias(name)]
    figures = []
    for span, names in frames.items():
        figures += _figures(_merged(_columns(f"_tail_{span}_"), _columns(f"_head_{span}_")), names)
    return work.select("_row.*", *figures, *results)


def rolling_metrics(
    df: DataFrame, mode: str = "rows", value: str = "temperature", block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """7- and 30-day mean and volatility and the 24-hour trend of each reading.

    ``rows`` counts readings (the current and 168 / 720 before it, and the one 24
    earlier), which equals time on gap-free hourly data; ``time`` uses true spans.
    """
    if mode == "rows":
        frames = dict(zip((ROWS_7D, ROWS_30D), METRIC_NAMES))
        return rolling_rows(df, value, frames, {ROWS_24H: TREND}, block_rows=block_rows)
    if mode == "time":
        frames = dict(zip((7 * DAY, 30 * DAY), METRIC_NAMES))
        return rolling_time(df, value, frames, (24 * HOUR, 30 * HOUR, TREND), block_rows=block_rows)
    raise ValueError(f"unknown mode {mode!r}")


def variation_volatility(
    df: DataFrame, value: str = "temperature", rows: int = ROWS_7D, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Deviation of the reading-to-reading differences over the last ``rows`` rows."""
    steps = rolling_rows(df, value, {}, {1: "variation"}, block_rows=block_rows)
    names = ("variation_moyenne", "variation_volatilite")
    return rolling_rows(steps, "variation", {rows: names}, block_rows=block_rows).drop(names[0])
