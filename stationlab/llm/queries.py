"""The registered queries of the operators, over whole tables with production parameters."""

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stationlab.llm import (
    alignment,
    decontaminate,
    hilbert_search,
    licences,
    mixing,
    pitman_yor,
    prefix_trie,
    private_spans,
    quality,
    simhash,
    suffix_dedup,
    token_files,
    toxicity,
)
from stationlab.llm.common import shared_folder, table

TOKENIZER = "word_bpe_49k.json"
ALIGNED = "byte_bpe_50k.json", "piece_bpe_32k.model"


def token_output(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as token-id files, read back."""
    out = shared_folder(spark, "token-ids")
    token_files.write(table(spark, folder, "documents"), out, public_tokenizers.path(TOKENIZER))
    return token_files.read(spark, out)


def simhash_groups(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_copies(table(spark, folder, "documents"))


def mixed(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.taken(table(spark, folder, "documents"))


def toxic(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    labels = table(spark, folder, "labels")
    model = toxicity.fit(docs, labels.filter(~toxicity.held_out()))
    return toxicity.score(docs, model).select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


def leaked(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def licensed(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as files ``source/lang/shelf/doc_id``, a hundred ids to a shelf.

    The table names no licence files; a document that opens or closes with a notice is taken as one.
    """
    docs = table(spark, folder, "documents")
    shelf = F.floor(F.col("doc_id") / 100).cast("string")
    files = docs.select(F.concat_ws("/", "source", "lang", shelf, "doc_id").alias("path"), "doc_id", "text")
    notice = r"(?i)\A[^\n]*licen[cs]e|licen[cs]e[^\n]*\z"
    return licences.scan(files, licence_file=F.col("text").rlike(notice))


def judged(spark: SparkSession, folder: str) -> DataFrame:
    """Sources as hosts, a source's languages as its paths."""
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    return quality.score(docs, labels, F.col("source"), F.concat_ws("/", "source", "lang"))


def unrepeated(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.digests(table(spark, folder, "documents"))


def scored(spark: SparkSession, folder: str) -> DataFrame:
    return pitman_yor.score(table(spark, folder, "documents"))


def nearest(spark: SparkSession, folder: str) -> DataFrame:
    return hilbert_search.search(table(spark, folder, "embeddings"), "vec_id % 20 = 0")


def private(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return private_spans.spans(docs, private_spans.fit(private_spans.labelled(docs)))


def prefixes(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie.nodes(table(spark, folder, "conversations"))


def aligned(spark: SparkSession, folder: str) -> DataFrame:
    return alignment.align(table(spark, folder, "documents"), *map(public_tokenizers.path, ALIGNED))[0]


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_licence_scan": licensed,
    "op2_token_output": token_output,
    "op3_quality": judged,
    "op4_suffix_dedup": unrepeated,
    "op5_pitman_yor": scored,
    "op6_simhash": simhash_groups,
    "op7_mixing": mixed,
    "op8_toxicity": toxic,
    "op9_decontamination": leaked,
    "op10_hilbert_search": nearest,
    "op11_private_spans": private,
    "op12_prefix_trie": prefixes,
    "op13_alignment": aligned,
}

ORACLES: dict[str, str] = {
    "op7_mixing": f"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
    CAST('0x' || substr(md5('{mixing.SEED}' || coalesce(':' || doc_id, '')), 1, 8) AS BIGINT) AS h
  FROM documents),
per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM sized GROUP BY source),
weighed AS (
  SELECT *, CAST([3, 1, 2][CAST(rank % 3 + 1 AS INT)] AS DOUBLE) AS weight, 2 * source_size AS cap,
    1.5 * CAST(sum(source_size) OVER () AS DOUBLE) AS total FROM per),
need AS (
  SELECT *, coalesce(sum(cap) OVER n, 0) AS caps, coalesce(sum(weight) OVER n, 0) AS gone,
    sum(weight) OVER () AS weights
  FROM weighed WINDOW n AS (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
filled AS (SELECT *, (total - caps) / (weights - gone) >= cap / weight AS is_full FROM need),
goal AS (
  SELECT source, source_size, rank, CASE WHEN is_full THEN CAST(cap AS DOUBLE)
    ELSE (total - coalesce(sum(cap) FILTER (is_full) OVER (), 0)) * weight
      / sum(weight) FILTER (NOT is_full) OVER () END AS target FROM filled),
whole AS (
  SELECT sum(target) AS total, greatest(1, least({mixing.BLOCK_WORDS}, CAST(floor(sum(target) / {mixing.LEAST_SLOTS}) AS BIGINT))) AS block
  FROM goal),
line AS (
  SELECT rank, CASE WHEN rank = max(rank) OVER () THEN {mixing.POINTS}
    ELSE CAST(floor(sum(target) OVER (ORDER BY rank) / total * {mixing.POINTS}) AS BIGINT) END AS high FROM goal, whole),
points AS (
  SELECT slot, slot * {mixing.GOLDEN} % {mixing.POINTS} AS point
  FROM whole, (SELECT unnest(range(CAST(ceil(floor(total) / block) AS BIGINT))) AS slot FROM whole)),
counted AS (
  SELECT rank, count(*) AS n FROM (SELECT min(rank) AS rank, slot FROM points JOIN line ON point < high GROUP BY slot) GROUP BY rank),
laid AS (
  SELECT s.doc_id, s.size, g.source_size, g.target, n * block AS reach,
    coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY h, s.doc_id NULLS FIRST, size
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a
  FROM sized s JOIN goal g ON s.source IS NOT DISTINCT FROM g.source LEFT JOIN counted c ON c.rank = g.rank, whole)
SELECT doc_id, size, source_size, target,
  CAST(greatest(0, least(size, coalesce(reach, 0) - a)) + greatest(0, least(size, coalesce(reach, 0) - a - source_size)) AS BIGINT) AS taken
FROM laid""",
    "op12_prefix_trie": f"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (
    PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT conv_id AS c, conv_id - conv_id % {prefix_trie.FAMILY} AS b, xor(list_reduce(
    list_prepend(4294967295::BIGINT, [ascii(x)::BIGINT FOR x IN string_split(conv_id::VARCHAR, '')]),
    lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [k::BIGINT FOR k IN range(8)]),
      lambda v, k: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384::BIGINT) ELSE v // 2 END)), 4294967295::BIGINT)
    % {prefix_trie.HEADS} AS h
  FROM (SELECT DISTINCT conv_id FROM t)),
heads AS (SELECT c, pos AS q, role, text FROM c JOIN t ON conv_id = b AND pos <= h),
kept AS (SELECT c, count(*) AS k FROM heads GROUP BY c),
rebuilt AS (
  SELECT * FROM heads UNION ALL
  SELECT c.c, pos - h + coalesce(k, 0), role, text FROM c JOIN t ON conv_id = c AND pos > h LEFT JOIN kept ON kept.c = c.c),
paths AS (
  SELECT c, 0::BIGINT AS d, 'root' AS key, NULL AS up, 0::BIGINT AS size FROM c UNION ALL
  SELECT c, q, key, coalesce(lag(key) OVER (PARTITION BY c ORDER BY q), 'root'), size FROM (
    SELECT c, q, strlen(text) AS size, md5(string_agg(sha256(length(role) || ':' || role || text), ',')
      OVER (PARTITION BY c ORDER BY q)) AS key FROM rebuilt)),
met AS (
  SELECT d, key, min(c) AS c, min(up) AS up, count(*) AS n, (count(*) - 1) * min(size) AS gain FROM paths GROUP BY d, key),
kids AS (SELECT up AS key, count(*) AS n FROM met WHERE d > 0 GROUP BY up),
node AS (SELECT met.*, coalesce(kids.n, 0) AS n_children FROM met LEFT JOIN kids ON kids.key = met.key),
below AS (
  SELECT p.key, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(gain) AS saved
  FROM node JOIN paths p ON p.c = node.c AND p.d <= node.d GROUP BY p.key),
ends AS (
  SELECT key, string_agg(c::VARCHAR, ',' ORDER BY c) AS ids FROM (SELECT c, arg_max(key, d) AS key FROM paths GROUP BY c) GROUP BY key)
SELECT node.c AS conv_id, node.d AS depth, parent.c AS parent_conv_id, node.n AS n_convs, node.n_children,
  CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM node JOIN below ON below.key = node.key LEFT JOIN node parent ON parent.key = node.up LEFT JOIN ends ON ends.key = node.key""",
}
