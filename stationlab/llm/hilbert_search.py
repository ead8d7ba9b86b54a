"""Nearest neighbours by largest inner product along several shifted Hilbert orderings.

A curve orders randomly projected vectors by their place on a Hilbert curve.  Neighbours in
space tend to be neighbours on some curve, so a query is compared exactly with the windows
around its place on each curve and the windows' best are merged.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stationlab.llm.common import cut

CURVES = 12
AXES = 6
BITS = 63 // AXES
WINDOW = 0.12
"""Share of a curve, around the query, that a query is compared with, in whole blocks."""
BLOCK = 4096
"""Vectors in a block of a curve."""
QUERIES = 4096
"""Queries compared with a block in one go; blocks are repeated when more queries come."""
SEED = 11


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of points with whole coordinates below 2 ** bits.

    The transpose form: inverse undo of the rotations from the top bit down, Gray decoding,
    then the bits of all axes interleaved.
    """
    x = cells.astype(np.int64).T.copy()
    axes = len(x)
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        low = q - 1
        for i in range(axes):
            high = (x[i] & q) > 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
    for i in range(1, axes):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        turn ^= np.where((x[-1] & q) > 0, q - 1, 0)
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(axes):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def projections(curve: int, dim: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Orthonormal axes (``AXES`` of ``dim`` + 1) and shifts of one curve."""
    rng = np.random.default_rng([seed, curve])
    axes = np.linalg.qr(rng.normal(size=(dim + 1, min(AXES, dim + 1))))[0]
    return axes, rng.uniform(0, 1, axes.shape[1])


def keys(vectors: np.ndarray, longest: float, curve: int, seed: int = SEED) -> np.ndarray:
    """Keys of one curve.  A last coordinate lifts all vectors to the length ``longest``, so that
    the nearest by angle are the largest inner products."""
    unit = vectors / longest
    lift = np.sqrt(np.maximum(0.0, 1.0 - (unit * unit).sum(axis=1)))
    axes, shift = projections(curve, vectors.shape[1], seed)
    at = np.c_[unit, lift] @ axes * np.sqrt(len(axes) / 4.0)  # mostly within -2..2
    cells = (np.clip((at + 4.0) / 10.0, 0, 0.8) + shift * 0.19) * (1 << BITS)
    return hilbert_keys(np.clip(cells.astype(np.int64), 0, (1 << BITS) - 1), BITS)


def usable(table: DataFrame) -> DataFrame:
    """(vec_id, v) of the vectors that take part: not null, not zero, without null or non-finite
    components, and of the table's most frequent length (the longer of equally frequent ones)."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = table.filter(finite & F.exists("embedding", lambda x: x != 0) & F.col("vec_id").isNotNull()).select(
        F.col("vec_id").cast("long").alias("vec_id"),
        # Adding zero makes -0.0 equal to 0.0.
        F.transform("embedding", lambda x: x.cast("double") + F.lit(0.0)).alias("v"),
    )
    lengths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return rows.filter(F.size("v") == (lengths["n"] if lengths else 0))


def _ranked(classes: DataFrame, longest: float, curves: int, seed: int) -> DataFrame:
    """(curve, class_id, rank): places on each curve, by range partitions and their counts."""

    def keyed(batches):
        for pdf in batches:
            v = np.stack(pdf["v"].to_numpy()) if len(pdf) else np.zeros((0, 1))
            for c in range(curves if len(pdf) else 0):
                yield pd.DataFrame({"curve": c, "key": keys(v, longest, c, seed), "class_id": pdf["class_id"]})

    def numbered(batches):
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), {}
        for pdf in batches:
            place = pdf.groupby("curve").cumcount() + pdf["curve"].map(seen).fillna(0).astype("int64")
            for c, n in pdf["curve"].value_counts().items():
                seen[c] = seen.get(c, 0) + int(n)
            yield pd.DataFrame({"curve": pdf["curve"], "class_id": pdf["class_id"], "part": part, "place": place})

    n = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["curve", "key", "class_id"]
    on_curves = cut(classes.mapInPandas(keyed, "curve int, key long, class_id long"))
    placed = on_curves.repartitionByRange(n, *order).sortWithinPartitions(*order)
    placed = cut(placed.mapInPandas(numbered, "curve int, class_id long, part int, place long"))
    parts = placed.groupBy("curve", "part").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy("curve").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("curve", "part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    return placed.join(F.broadcast(parts) if n * curves <= 1_000_000 else parts, ["curve", "part"]).select(
        "curve", "class_id", (F.col("_before") + F.col("place")).alias("rank")
    )


def inner_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, added up in the order of the components."""
    total = np.zeros(len(a))
    for i in range(a.shape[1]):
        total += a[:, i] * b[:, i]
    return total


def _best(queries: pd.DataFrame, block: pd.DataFrame, k: int) -> pd.DataFrame:
    """Per query the ``k`` best of a block by (score, smaller class), scores exact."""
    if not len(queries) or not len(block):
        return pd.DataFrame({"query_class": [], "class_id": [], "score": []}).astype({"query_class": "int64", "class_id": "int64"})
    q, v = np.stack(queries["v"].to_numpy()), np.stack(block["v"].to_numpy())
    found = []
    for low in range(0, len(q), 256):
        rough = q[low : low + 256] @ v.T
        worst = np.partition(rough, -min(k, len(v)), axis=1)[:, -min(k, len(v))]
        slack = 1e-9 * np.maximum(1.0, np.abs(worst))
        found.append(np.argwhere(rough >= (worst - slack)[:, None]) + [low, 0])
    row, column = np.concatenate(found).T
    out = pd.DataFrame(
        {
            "query_class": queries["class_id"].to_numpy()[row],
            "class_id": block["class_id"].to_numpy()[column],
            "score": inner_products(q[row], v[column]),
        }
    )
    out = out.sort_values(["query_class", "score", "class_id"], ascending=[True, False, True])
    return out[out.groupby("query_class").cumcount() < k]


def search(
    table: DataFrame,
    is_query,
    k: int = 20,
    curves: int = CURVES,
    window: float = WINDOW,
    block: int = BLOCK,
    seed: int = SEED,
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` best by inner product, in double precision.

    ``is_query`` is a condition on vec_id; candidates are all usable vectors but the query
    itself.  Equal vectors are indexed once, with their k + 1 smallest ids, which is all that
    an answer can hold.  Ties go to the smaller id; with fewer than ``k`` candidates, all are
    returned.  An id that occurs with several vectors is several vectors.  Vectors that take
    no part ask nothing; no usable vectors give no rows.  Other columns are ignored.
    """
    spark = table.sparkSession
    rows = cut(usable(table))
    by_id = Window.partitionBy("v").orderBy("vec_id")
    members = rows.withColumn("_i", F.row_number().over(by_id)).filter(F.col("_i") <= k + 1).select("v", "vec_id")
    classes = cut(rows.groupBy("v").agg(F.min("vec_id").alias("_id")).select("v", F.xxhash64("v").alias("_h"), "_id"))
    # Two vectors under one id would share a class; the hash keeps them apart.
    classes = cut(classes.withColumn("class_id", F.when(F.count("*").over(Window.partitionBy("_id")) > 1, F.col("_h")).otherwise(F.col("_id"))))
    n, longest = classes.agg(F.count("*"), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)))).first()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    members = cut(members.join(classes, "v").select("class_id", "vec_id"))
    asked = cut(rows.filter(is_query).select("v", F.col("vec_id").alias("query_id")).join(classes, "v").select("class_id", "query_id"))
    query_classes = asked.select("class_id").distinct()
    ranked = cut(_ranked(classes.select("class_id", "v"), longest, curves, seed))
    half = max(1, int(np.ceil(window * n / 2)))
    low = F.greatest(F.lit(0), F.least(F.col("rank") - half, F.lit(n - 1 - 2 * half)))
    high = F.least(F.lit(n - 1), F.greatest(F.col("rank") + half, F.lit(2 * half)))
    requests = ranked.join(query_classes, "class_id").select(
        "curve", "class_id", F.explode(F.sequence(F.expr("0L") + F.floor(low / block), F.floor(high / block))).alias("block")
    )
    requests = cut(requests)
    fullest = requests.groupBy("curve", "block").count().agg(F.max("count")).first()[0] or 1
    salts = -(-fullest // QUERIES)
    salt = F.pmod(F.xxhash64("class_id"), F.lit(salts)).cast("int").alias("salt")
    vectors = classes.select("class_id", "v")
    requests = requests.select("*", salt).join(vectors, "class_id")
    index = ranked.select(
        "curve", "class_id", F.floor(F.col("rank") / block).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt")
    ).join(vectors, "class_id")
    group = ["curve", "block", "salt"]
    requests, index = requests.toDF(*requests.columns), index.toDF(*index.columns)
    near = requests.groupBy(*group).cogroup(index.groupBy(*group)).applyInPandas(
        lambda q, b: _best(q, b, k + 1), "query_class long, class_id long, score double"
    )
    best = Window.partitionBy("query_class").orderBy(F.desc("score"), "class_id")
    near = near.distinct().withColumn("_i", F.row_number().over(best)).filter(F.col("_i") <= k + 1)
    answers = (
        near.join(members, "class_id")
        .join(asked.withColumnRenamed("class_id", "query_class"), "query_class")
        .filter("vec_id <> query_id")
    )
    by_score = Window.partitionBy("query_id", "query_class").orderBy(F.desc("score"), "vec_id")
    return (
        answers.withColumn("rank", F.row_number().over(by_score))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
