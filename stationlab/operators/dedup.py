"""Uniqueness by key: keep-first, insert-or-ignore, append-unique.

"First" means smallest in a total order of the row's own values, so the result
does not depend on how rows were partitioned.  Copies of one key collapse in the
map-side half of the aggregate; a key holding a third of the rows sends one row
per task through the shuffle.

A null in a key is a value like any other: rows whose keys agree in their nulls, too, are one key, within a batch
and against the target, so that repeating an insert adds nothing.
"""

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stationlab.schemas import KEYS


class DuplicateKeys(ValueError):
    """A batch holds keys that the target already has, or repeats its own."""


def row_rank(df: DataFrame, order: tuple[str, ...], rest: list[str]) -> Column:
    """A struct whose natural order is ``order`` first, then all remaining columns."""
    return F.struct(*order, *[c for c in rest if c not in order])


def first_per_key(
    df: DataFrame, keys: tuple[str, ...] = KEYS, order: tuple[str, ...] = ()
) -> DataFrame:
    """One row per key: the first by ``order``, ties broken by the other columns."""
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.select(*keys).distinct()
    picked = df.groupBy(*keys).agg(F.min(row_rank(df, order, rest)).alias("_row"))
    return picked.select(*[c if c in keys else F.col(f"_row.{c}") for c in df.columns])


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Rows of every frame by column name; a missing column is null."""
    first, *others = frames
    for other in others:
        first = first.unionByName(other, allowMissingColumns=True)
    return first


def _same_key(a: DataFrame, b: DataFrame, keys: tuple[str, ...]) -> Column:
    equal = [a[k].eqNullSafe(b[f"_{k}"]) for k in keys]
    return functools.reduce(Column.__and__, equal)


def _keys_of(target: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    return target.select(*[F.col(k).alias(f"_{k}") for k in keys])


def new_rows(
    incoming: DataFrame,
    target: DataFrame,
    keys: tuple[str, ...] = KEYS,
    order: tuple[str, ...] = (),
) -> DataFrame:
    """Rows of ``incoming`` that an insert-or-ignore would add to ``target``."""
    unique = first_per_key(incoming, keys, order)
    known = _keys_of(target, keys)
    return unique.join(known, _same_key(unique, known, keys), "left_anti").select(*incoming.columns)


def insert_or_ignore(
    incoming: DataFrame,
    target: DataFrame,
    keys: tuple[str, ...] = KEYS,
    order: tuple[str, ...] = (),
) -> DataFrame:
    """``target`` followed by the rows of ``incoming`` whose key it lacks."""
    return union_all([target, new_rows(incoming, target, keys, order)])


def clashes(incoming: DataFrame, target: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Keys of ``incoming`` that ``target`` already holds."""
    some, known = incoming.select(*keys), _keys_of(target, keys)
    return some.join(known, _same_key(some, known, keys), "left_semi").distinct()


def repeated_keys(df: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1").select(*keys)


def append_unique(
    incoming: DataFrame, target: DataFrame, keys: tuple[str, ...] = KEYS
) -> DataFrame:
    """``target`` plus the whole batch, or :class:`DuplicateKeys` if any key repeats.

    Runs a query at once to find out.
    """
    bad = clashes(incoming, target, keys).unionByName(repeated_keys(incoming, keys))
    if not bad.isEmpty():
        raise DuplicateKeys(f"keys {keys} repeat in the batch or exist in the target")
    return union_all([target, incoming])
