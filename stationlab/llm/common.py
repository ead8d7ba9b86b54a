"""What several operators share: reading tables, narrow inputs, checked broadcasts, components."""

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stationlab.session import CHECKPOINT_CONF, checkpoint_folder

MAX_BROADCAST_BYTES = 64 << 20
"""No table of more estimated bytes than this is broadcast."""

SPACE = r"[\x20\x09-\x0D]+"
"""What stands between two words."""


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """``doc_id``, ``text`` (null becomes empty) and the columns named; no other column stays."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *more)


def fold(doc_id: str = "doc_id", folds: int = 5) -> Column:
    """CRC-32 of the id written as text, modulo ``folds``.  A null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new folder name inside the folder that all executors share."""
    checkpoint_folder(spark)
    base = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder that an operator made for itself, once nothing reads it any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def unused(name: str, *frames: DataFrame) -> str:
    """A column name that no frame has."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def cut(df: DataFrame) -> DataFrame:
    """The same rows from files in the shared folder: lineage ends here."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def broadcast_if_small(df: DataFrame, row_bytes: int, max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """``df`` marked for broadcast if its counted rows, at ``row_bytes`` each, stay within the bound."""
    return F.broadcast(df) if df.count() * row_bytes <= max_bytes else df


def encoded(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each string, nulls as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def in_chunks(items: Iterable, limit: int) -> Iterator[list]:
    """Runs of items whose lengths add up to ``limit`` or just over."""
    some, size = [], 0
    for x in items:
        some.append(x)
        size += len(x) + 1
        if size >= limit:
            yield some
            some, size = [], 0
    if some:
        yield some


def gathered(flat: np.ndarray, ends: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of ``flat`` between ``ends`` at ``places``, one after the other, and their ends (from 0)."""
    size = ends[places + 1] - ends[places]
    out = np.append(0, np.cumsum(size))
    return flat[np.repeat(ends[places] - out[:-1], size) + np.arange(out[-1])], out


def partitions(df: DataFrame, each: int = 64 << 20) -> int:
    """Partitions for ``df`` at ``each`` estimated bytes, no fewer than the session's own number."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(least, min(-(-size // each), 1 << 20))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of an undirected graph: (node, component), component the least node.

    ``edges`` has two long columns ``a`` and ``b``.  Alternates the large-star and small-star
    steps, each a grouped minimum and an equi-join, until the edges are stars.  A hub is a
    grouped minimum combined before the shuffle and a join that adaptive execution splits.
    Loops, repeated edges and edges with nulls are ignored; no edge gives an empty table.
    """
    at = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        state = at.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen or state[0] == 0:
            return at.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
                at.select(F.col("b"), F.col("b")).distinct()
            )
        seen = state
        both = at.union(at.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        at = cut(
            small.select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(least.select("a", F.col("m")))
            .filter("a <> b")
            .distinct()
        )
