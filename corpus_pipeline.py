"""A corpus from raw documents to token-id files, stage by stage."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stationlab.llm import decontaminate, mixing, simhash, token_files, toxicity
from stationlab.llm.common import broadcast_if_small, cut, remove_folder, shared_folder, table, unused
from stationlab.llm.queries import TOKENIZER

ID_BYTES = 48
MEMO_BYTES = 40 << 20
"""Less than alone: the workers of the other stages share the executor's memory."""


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The documents whose id is not in ``gone``; those without an id stay."""
    return docs.join(broadcast_if_small(cut(gone.distinct()), ID_BYTES), "doc_id", "left_anti")


def drop_toxic(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents not predicted toxic by a model fitted to all labels.

    Rows that share an id go together if one of them is toxic; those without an id stay.  A null or empty text has
    a score like any other; a score of exactly one half is toxic.  No rows keep none.
    """
    model = toxicity.fit(docs, table(spark, folder, "labels"))
    return _without(docs, toxicity.score(docs, model).filter("predicted = 1").select("doc_id"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of near copies: the one of the smallest id.

    Rows that share an id, or have none, are told apart by their texts: of a group whose smallest id repeats, or
    that has no id at all, the row of the smallest text stays, and of equal rows the smallest in their other columns.  Null,
    empty and blank texts are copies of each other.  No rows keep none.
    """
    prints = cut(simhash.near_copies(docs).groupBy("doc_id", "fingerprint", "component_id").agg(F.count("*").alias("n")))
    several = prints.groupBy("doc_id").agg(F.sum("n").alias("n")).filter("n > 1 OR doc_id IS NULL")
    gone = prints.filter("doc_id <> component_id").select("doc_id")
    odd, key, rest = (unused(x, docs) for x in ("odd", "key", "rest"))
    several = cut(several.select(F.col("doc_id").alias(odd)))
    if several.isEmpty():
        return _without(docs, gone)
    several = broadcast_if_small(several, ID_BYTES)
    same = docs["doc_id"].eqNullSafe(several[odd])
    plain = _without(docs.join(several, same, "left_anti"), gone)
    # Rows of such ids: their groups by fingerprint, then one row of a group, if its smallest id is theirs.
    some = docs.join(several, same, "left_semi").withColumn(key, F.xxhash64("doc_id", "text"))
    texts_of = some.groupBy(key).agg(F.min("text").alias("text")).withColumnRenamed(key, "doc_id")
    named = simhash.fingerprints(texts_of).select(F.col("doc_id").alias(key), F.lpad(F.lower(F.hex("fp")), 16, "0").alias(odd))
    groups = prints.select(*[F.col(c).alias(f"{odd}_{n}") for c, n in (("doc_id", "id"), ("fingerprint", "print"), ("component_id", "least"))])
    met = some.join(named, key)
    met = met.join(groups, met["doc_id"].eqNullSafe(groups[f"{odd}_id"]) & (met[odd] == groups[f"{odd}_print"]))
    first = met.filter(F.col("doc_id").eqNullSafe(F.col(f"{odd}_least")))
    # A group without any id has no name; its rows are told apart by fingerprint.
    group = F.coalesce(F.col(f"{odd}_least").cast("string"), F.col(odd))
    columns = [c for c in docs.columns if c not in ("doc_id", "text")]
    one = first.groupBy("doc_id", group.alias(key)).agg(F.min(F.struct("text", *columns)).alias(rest))
    return plain.unionByName(one.select("doc_id", f"{rest}.*").select(*docs.columns))


def drop_leaks(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Rows that share an id go together if one of them holds an item; those without an id stay.  Null and empty texts hold
    none.  No rows keep none.
    """
    return _without(docs, decontaminate.leaks(docs, table(spark, folder, "benchmark")).select("doc_id"))


def mix(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Each document as often as the mix passes over it: a pass counts from half of its words on.

    Rows of one id, the null id too, are taken alike, as often as the most taken of them.  Null and empty texts have no
    words and are never taken.  No rows keep none.
    """
    per_pass = mixing.spans(docs).groupBy("source", "cell", "row", "doc_id", "size", "pass").agg(F.sum("n_words").alias("_n"))
    counts = ((F.col("size") > 0) & (2 * F.col("_n") >= F.col("size"))).cast("int")
    per_row = per_pass.groupBy("source", "cell", "row", "doc_id").agg(F.sum(counts).alias("_times"))
    key, times, copy = (unused(x, docs) for x in ("id", "times", "copy"))
    passes = per_row.groupBy(F.col("doc_id").alias(key)).agg(F.max("_times").alias(times)).filter(F.col(times) > 0)
    passes = broadcast_if_small(cut(passes), ID_BYTES)
    copies = F.explode(F.sequence(F.lit(1), F.col(times)))
    return docs.join(passes, docs["doc_id"].eqNullSafe(passes[key])).withColumn(copy, copies).select(*docs.columns)


def write_tokens(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Token-id files of the mix, read back: doc_id, start, n_tokens, ids_crc32.

    Null ids come first, rows of one id follow each other; null and empty texts have the end id alone.  No rows write none.
    """
    out = shared_folder(spark, "corpus-token-ids")
    token_files.write(docs, out, public_tokenizers.path(TOKENIZER), memo_bytes=MEMO_BYTES)
    return token_files.read(spark, out)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_copies),
    ("decontamination", drop_leaks),
    ("mixing", mix),
    ("token_output", write_tokens),
]

ORACLE_SQL = None
"""Fingerprints, the fitted model and the tokenizer are beyond SQL; the tests use brute force."""


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again.

    A stage's rows are removed when the next stage has written its own.
    """
    docs, before = table(spark, folder, "documents"), None
    for name, stage in STAGES[:-1]:
        out = shared_folder(spark, f"corpus-{name}")
        stage(spark, docs, folder).write.parquet(out)
        docs = spark.read.schema(docs.schema).parquet(out)
        if before:
            remove_folder(spark, before)
        before = out
    result = STAGES[-1][1](spark, docs, folder)
    remove_folder(spark, before)  # the last stage reads the files that it wrote
    return result
