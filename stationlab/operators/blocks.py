"""Split the time line of heavy stations into blocks that windows can share.

``Window.partitionBy("station")`` puts a station into one task, and a station may
hold a third of all rows.  Here each heavy station's line is cut into consecutive
blocks of bounded size, and the rows that a block's first frames look back to are
copied into it, marked ``_halo``.  A window partitioned by (station, ``_block``)
then gives the same values as one partitioned by station, once the copies are
dropped.

Rows are placed by counting them per (station, time slice).  Slices that hold too
many rows are cut finer, down to one microsecond, then by a hash of the row, and at
last copies of one row are numbered and cut by number; so a burst is split as well.
Only heavy stations appear in the placement table; it is broadcast when a count
shows that it is small, and joined by key otherwise.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stationlab.operators.joins import join_checked
from stationlab.session import checkpoint_folder

BLOCK_ROWS = 500_000
# Slice widths in microseconds, each a multiple of the next: day, minute,
# millisecond, microsecond.  Below that rows are split by hash.
WIDTHS = (86_400_000_000, 60_000_000, 1_000, 1)
# The top bits of the hash pick the slice; the rest make room for copy numbers.
HASH_SHIFT, COPY_SHIFT = 52, 12


def micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def ordered(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Add the order of rows: microseconds, then a hash of the whole row."""
    return df.withColumns({"_us": micros(ts), "_tie": F.xxhash64(*df.columns)})


def _slice(us: Column, width: int) -> Column:
    return us - F.pmod(us, F.lit(width))


def _day() -> dict[str, Column]:
    """The slice every row starts in."""
    return {"_s": _slice(F.col("_us"), WIDTHS[0]), "_h": F.lit(0).cast("long")}


def _hash_bits() -> Column:
    """The hash with all but its top bits cleared."""
    return F.shiftleft(F.shiftright("_tie", HASH_SHIFT), HASH_SHIFT)


def _hash_slice(tie: Column) -> Column:
    return F.shiftright(tie, COPY_SHIFT)


def _numbered(copies: DataFrame, block_rows: int) -> DataFrame:
    """Groups of ``_c`` copies as chunks of at most ``block_rows``, each its own slice.

    The chunk number goes into ``_tie`` between the slice bits and the low bits, so
    the order of rows still agrees with the order of slices.
    """
    chunks = F.sequence(F.lit(0).cast("long"), F.floor((F.col("_c") - 1) / block_rows))
    low = F.col("_tie").bitwiseAND(F.lit((1 << COPY_SHIFT) - 1).cast("long"))
    tie = _hash_bits() + F.col("_chunk") * (1 << COPY_SHIFT) + low
    left = F.col("_c") - F.col("_chunk") * block_rows
    return (
        copies.withColumn("_chunk", F.explode(chunks))
        .withColumns({"_tie": tie, "_c": F.least(left, F.lit(block_rows).cast("long"))})
        .withColumn("_h", _hash_slice(F.col("_tie")))
        .drop("_chunk")
    )


Step = tuple[DataFrame, int | None]


def _cut(rows: DataFrame, key: str, step: Step) -> DataFrame:
    """Move rows of the step's heavy slices to finer slices."""
    heavy, width = step
    rows = join_checked(rows, heavy, [key, "_s", "_h"], "left")
    if width is None:
        finer = F.when(F.col("_heavy"), _hash_slice(_hash_bits())).otherwise(F.col("_h"))
        return rows.withColumn("_h", finer).drop("_heavy")
    finer = F.when(F.col("_heavy"), _slice(F.col("_us"), width)).otherwise(F.col("_s"))
    return rows.withColumn("_s", finer).drop("_heavy")


def _count(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key, "_s", "_h").agg(F.count("*").alias("_n"))


def _slices(
    rows: DataFrame, key: str, block_rows: int
) -> tuple[DataFrame, list[Step], DataFrame | None]:
    """Rows per slice, with slices of more than ``block_rows`` cut finer; also how.

    Third comes the list of slices whose rows are numbered by copy, if there are any.
    After the first pass only the rows of heavy slices are looked at again.
    """
    slices, steps = _count(rows, key).checkpoint(), []
    too_big = F.col("_n") > block_rows
    for width in (*WIDTHS[1:], None):
        # At most rows / block_rows of them.
        heavy = slices.filter(too_big).select(key, "_s", "_h", F.lit(True).alias("_heavy"))
        if heavy.isEmpty():
            return slices, steps, None
        steps.append((heavy, width))
        inside = join_checked(rows, heavy.drop("_heavy"), [key, "_s", "_h"], "left_semi")
        rows = _cut(inside, key, steps[-1])
        slices = slices.filter(~too_big).unionByName(_count(rows, key)).checkpoint()

    crowded = slices.filter(too_big).select(key, "_s", "_h")
    if crowded.isEmpty():
        return slices, steps, None
    copies = (
        join_checked(rows, crowded, [key, "_s", "_h"], "left_semi")
        .groupBy(key, "_us", "_tie", "_s", "_h")
        .agg(F.count("*").alias("_c"))
    )
    chunks = _numbered(copies, block_rows).groupBy(key, "_s", "_h").agg(F.sum("_c").alias("_n"))
    return slices.filter(~too_big).unionByName(chunks).checkpoint(), steps, crowded


def _placement(slices: DataFrame, key: str, halo_rows: int, block_rows: int) -> DataFrame:
    """For every slice of a heavy station: the blocks that need its rows.

    A block starts where the running count passes a multiple of ``block_rows``.
    A slice also goes to a later block if it ends less than ``halo_rows`` before
    that block starts; two blocks ahead suffice because two blocks in a row hold
    at least ``block_rows`` between them.
    """
    line = Window.partitionBy(key).orderBy("_s", "_h")
    counted = slices.withColumn(
        "_end", F.sum("_n").over(line.rowsBetween(Window.unboundedPreceding, 0))
    ).withColumn("_total", F.sum("_n").over(Window.partitionBy(key)))
    heavy = counted.filter(F.col("_total") > block_rows).withColumn(
        "_block", F.floor((F.col("_end") - F.col("_n")) / block_rows)
    )
    order = Window.partitionBy(key).orderBy("_block")
    starts = (
        heavy.groupBy(key, "_block")
        .agg(F.min(F.col("_end") - F.col("_n")).alias("_start"))
        .select(
            key,
            "_block",
            F.array(
                *[
                    F.struct(
                        F.lead("_block", k).over(order).alias("block"),
                        F.lead("_start", k).over(order).alias("start"),
                    )
                    for k in (1, 2)
                ]
            ).alias("_later"),
        )
    )
    needed = F.filter(
        "_later", lambda b: b["start"].isNotNull() & (b["start"] - F.col("_end") < halo_rows)
    )
    return heavy.join(starts, [key, "_block"]).select(
        key,
        "_s",
        "_h",
        F.concat(
            F.array(F.struct(F.col("_block").alias("block"), F.lit(False).alias("halo"))),
            F.transform(needed, lambda b: F.struct(b["block"].alias("block"), F.lit(True).alias("halo"))),
        ).alias("_places"),
    )


@dataclass(frozen=True)
class Blocks:
    """Where the rows of each key go.  Made by :func:`plan_blocks`."""

    key: str
    block_rows: int
    steps: list[Step]
    crowded: DataFrame | None
    places: DataFrame | None
    heavy_keys: DataFrame | None

    @property
    def cut(self) -> bool:
        """Whether any key has more than one block."""
        return self.places is not None

    def place(self, df: DataFrame) -> DataFrame:
        """Add ``_block`` and ``_halo`` to rows with (key, _us, _tie), copying halo rows.

        Rows of light keys find no place and form block 0 of their key.
        """
        if not self.cut:
            return df.withColumns({"_block": F.lit(0).cast("long"), "_halo": F.lit(False)})
        rows = df.withColumns(_day())
        for step in self.steps:
            rows = _cut(rows, self.key, step)
        if self.crowded is not None:
            rows = self._number_copies(rows)
        whole = F.array(F.struct(F.lit(0).cast("long").alias("block"), F.lit(False).alias("halo")))
        return (
            join_checked(rows, self.places, [self.key, "_s", "_h"], "left")
            .withColumn("_p", F.explode(F.coalesce("_places", whole)))
            .withColumns({"_block": F.col("_p.block"), "_halo": F.col("_p.halo")})
            .select(*df.columns, "_block", "_halo")
        )

    def _number_copies(self, rows: DataFrame) -> DataFrame:
        """Spread copies of one row over slices of bounded size.

        They travel as one row and a count, and come back chunk by chunk in the task
        of their chunk.
        """
        slice_of = [self.key, "_s", "_h"]
        others = join_checked(rows, self.crowded, slice_of, "left_anti")
        copies = (
            join_checked(rows, self.crowded, slice_of, "left_semi")
            .groupBy(*rows.columns)
            .agg(F.count("*").alias("_c"))
        )
        again = (
            _numbered(copies, self.block_rows)
            .repartition(*slice_of)
            .withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_c"))))
            .select(*rows.columns)
        )
        return others.unionByName(again)

    def heavy(self, df: DataFrame) -> DataFrame:
        """Only the rows of keys that were cut."""
        return join_checked(df, self.heavy_keys, [self.key], "left_semi")


def plan_blocks(
    lines: DataFrame,
    halo_rows: int,
    key: str = "station",
    block_rows: int = BLOCK_ROWS,
) -> Blocks:
    """Decide the blocks from rows with (key, _us, _tie).

    ``_us`` orders rows, ``_tie`` is a hash of the row that orders those of one ``_us``;
    equal (key, _us, _tie) stands for copies of one row.

    Counts rows per key at once, and per time slice for keys over ``block_rows``;
    when there are none, placing rows adds neither join nor copies.  The input must
    give the same rows each time it is read.
    """
    if block_rows <= 2 * halo_rows:
        raise ValueError("block_rows must exceed twice the halo")
    checkpoint_folder(lines.sparkSession)
    lines = lines.select(key, "_us", "_tie")
    heavy_keys = (
        lines.groupBy(key)
        .agg(F.count("*").alias("_n"))
        .filter(F.col("_n") > block_rows)
        .select(key)
        .checkpoint()
    )
    if heavy_keys.isEmpty():
        return Blocks(key, block_rows, [], None, None, None)
    heavy_lines = join_checked(lines.withColumns(_day()), heavy_keys, [key], "left_semi")
    slices, steps, crowded = _slices(heavy_lines, key, block_rows)
    places = _placement(slices, key, halo_rows, block_rows).checkpoint()
    return Blocks(key, block_rows, steps, crowded, places, heavy_keys)
