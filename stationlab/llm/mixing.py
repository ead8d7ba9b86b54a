"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stationlab.llm.common import SPACE, cut

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
"""No document is taken more often than this."""
BLOCK_WORDS, LEAST_SLOTS = 256, 20_000
"""Words in a block; fewer when the mix would have fewer slots than ``LEAST_SLOTS``."""
POINTS = 1 << 31
GOLDEN = 1_327_217_885
"""POINTS times the golden ratio's fraction, made odd: i * GOLDEN mod POINTS spreads evenly."""
CELLS = 1 << 12
CHUNK = 1 << 16
SEED = "mix"


def words(text: str = "text") -> Column:
    """Number of words between ASCII white space; 0 for null."""
    parts = F.split(F.coalesce(F.col(text), F.lit("")), SPACE)
    return (
        F.size(parts)
        - (F.element_at(parts, 1) == "").cast("int")
        - ((F.size(parts) > 1) & (F.element_at(parts, -1) == "")).cast("int")
    ).cast("long")


def before(column: str, window: Window) -> Column:
    return F.coalesce(F.sum(column).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Per source of (source, size): source_size, rank, target.

    Sources by code point, null last, take the weights in turn.  ``share`` of all sizes is
    dealt by weight; what exceeds ``most`` times a source's size is dealt again among the
    rest until nothing does.  Sources that fill up are those of the least size per weight,
    so one sort finds them.  One row a source: the windows without a key see those rows only.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    per_source = (
        sizes.groupBy("source")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
        .withColumn("weight", weight.cast("double"))
        .withColumn("_cap", F.col("source_size") * most)
    )
    everything = Window.partitionBy()
    by_need = Window.orderBy(F.col("_cap") / F.col("weight"), "rank")
    total, weight_sum = F.sum("source_size").over(everything) * share, F.sum("weight").over(everything)
    level = (F.col("_total") - F.col("_caps")) / (F.col("_weights") - F.col("_gone"))
    filled = (
        per_source.withColumn("_total", total)
        .withColumn("_weights", weight_sum)
        .withColumn("_caps", before("_cap", by_need))
        .withColumn("_gone", before("weight", by_need))
        .withColumn("_full", level >= F.col("_cap") / F.col("weight"))
    )
    rest = F.col("_total") - F.coalesce(F.sum(F.when(F.col("_full"), F.col("_cap"))).over(everything), F.lit(0))
    free = F.sum(F.when(~F.col("_full"), F.col("weight"))).over(everything)
    return filled.withColumn(
        "target", F.when(F.col("_full"), F.col("_cap").cast("double")).otherwise(rest * F.col("weight") / free)
    ).select("source", "source_size", "rank", "target")


def placed(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """Each row with its size and its place: ``at``, the words before it in its source's shuffled order.

    The order is by a hash of id and seed.  A source is cut into cells of the hash, so that
    no task sorts a whole source; places are running totals of cells, then inside a cell.
    ``cell`` and ``row`` tell rows of one source apart.
    """
    hashed = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col("doc_id"))), 1, 8), 16, 10).cast("long")
    rows = docs.select("doc_id", "source", words().alias("size")).withColumn("_hash", hashed)
    rows = cut(rows.withColumn("cell", F.floor(F.col("_hash") / ((1 << 32) // CELLS)).cast("int")))
    cells = rows.groupBy("source", "cell").agg(F.sum("size").alias("_n"))
    cells = cells.withColumn("_before", before("_n", Window.partitionBy("source").orderBy("cell"))).drop("_n")
    inside = Window.partitionBy("source", "cell").orderBy("_hash", F.col("doc_id").asc_nulls_first(), "size")
    rows = rows.withColumn("_inside", before("size", inside)).withColumn("row", F.row_number().over(inside))
    same = rows["source"].eqNullSafe(cells["source"]) & (rows["cell"] == cells["cell"])
    return rows.join(cells, same, "left").select(
        rows["doc_id"], rows["source"], "size", rows["cell"], "row", (F.col("_before") + F.col("_inside")).alias("at")
    )


def slots(goal: DataFrame) -> DataFrame:
    """(rank, block, slot): which source's which block stands in which slot of the mix.

    Slot i has the point i * GOLDEN mod POINTS, mapped through the cumulative targets.  Points
    meet sources by an equi-join on cells of the line.  A slot's rank among its source's slots
    is the block it takes: counts of slot chunks first, then inside a chunk.
    """
    spark = goal.sparkSession
    total, block = _block(goal)
    n = -(-int(total) // block) if total else 0
    width = POINTS // CHUNK
    ends = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    line = goal.select(
        "rank", "target", F.floor(F.sum("target").over(ends) / F.lit(total or 1.0) * POINTS).alias("_high")
    )
    low = F.coalesce(F.lag("_high").over(Window.orderBy("rank")), F.lit(0))
    last = F.max("rank").over(Window.partitionBy())
    line = (
        line.withColumn("_low", low)
        .withColumn("_high", F.when(F.col("rank") == last, F.lit(POINTS)).otherwise(F.col("_high")))
        .filter("_high > _low")
        .withColumn("_cell", F.explode(F.expr(f"sequence(_low div {width}, (_high - 1) div {width})")))
    )
    points = (
        spark.range(n)
        .withColumnRenamed("id", "slot")
        .withColumn("_point", (F.col("slot") % POINTS) * GOLDEN % POINTS)
        .withColumn("_cell", F.expr(f"_point div {width}"))
    )
    chosen = points.join(line, "_cell").filter("_point >= _low AND _point < _high")
    chosen = cut(chosen.select("rank", "slot", F.expr(f"slot div {CHUNK}").alias("_chunk")))
    chunks = chosen.groupBy("rank", "_chunk").agg(F.count("*").alias("_n"))
    chunks = chunks.withColumn("_before", before("_n", Window.partitionBy("rank").orderBy("_chunk"))).drop("_n")
    inside = F.row_number().over(Window.partitionBy("rank", "_chunk").orderBy("slot")) - 1
    return chosen.withColumn("_inside", inside).join(chunks, ["rank", "_chunk"]).select(
        "rank", (F.col("_before") + F.col("_inside")).alias("block"), "slot"
    )


def _block(goal: DataFrame) -> tuple[float, int]:
    """Words in the whole mix and in a block."""
    total = goal.agg(F.sum("target")).first()[0] or 0.0
    return total, max(1, min(BLOCK_WORDS, int(total // LEAST_SLOTS)))


def spans(docs: DataFrame, seed: str = SEED, **how) -> DataFrame:
    """The mix: (slot, source, doc_id, from_word, n_words), and per row of ``docs`` one or more rows.

    A source's documents, shuffled and laid end to end, twice, are cut into blocks of equal
    words; slot by slot the schedule takes a source's next block.  Rows the mix does not touch
    have a null slot.  Also carried: size, source_size, target, pass, cell, row.  Equal on
    reruns.  Null texts and texts without words have size 0 and are never in a slot; a null
    source is a source, the last; a null id is an id; repeated rows are rows of their own.
    No rows give no rows.
    """
    rows = cut(placed(docs, seed))
    goal = cut(targets(rows, **how))
    _, block = _block(goal)
    most = how.get("most", MOST)
    same = rows["source"].eqNullSafe(goal["source"])
    laid = rows.join(F.broadcast(goal) if goal.count() <= 100_000 else goal, same).select(
        rows["*"], "source_size", "target", "rank"
    )
    laid = laid.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(most - 1))))
    laid = laid.withColumn("_from", F.col("at") + F.col("pass") * F.col("source_size"))
    touched = F.when(F.col("size") > 0, F.expr(f"sequence(_from div {block}, (_from + size - 1) div {block})"))
    laid = laid.withColumn("block", F.explode_outer(touched))
    met = laid.join(slots(goal), ["rank", "block"], "left")
    start = F.greatest(F.col("_from"), F.col("block") * block)
    end = F.least(F.col("_from") + F.col("size"), (F.col("block") + 1) * block)
    return met.select(
        "slot", "source", "doc_id", "size", "source_size", "target", "pass", "cell", "row",
        F.when(F.col("slot").isNotNull(), start - F.col("_from")).alias("from_word"),
        F.when(F.col("slot").isNotNull(), end - start).otherwise(F.lit(0)).alias("n_words"),
    )


def taken(docs: DataFrame, seed: str = SEED, **how) -> DataFrame:
    """Per row of ``docs``: doc_id, size, source_size, target, taken (words the mix takes of it)."""
    return (
        spans(docs, seed, **how)
        .groupBy("source", "cell", "row", "doc_id", "size", "source_size", "target")
        .agg(F.sum("n_words").alias("taken"))
        .select("doc_id", "size", "source_size", "target", "taken")
    )
