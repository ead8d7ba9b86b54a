"""Token-id files: each document's ids compressed on their own with one shared zstandard dictionary.

A folder holds two Parquet tables, written and read through Spark so that any store will do:
``dictionary`` (hash, bytes; one row) and ``blocks``: part, block, the dictionary's hash, and
per document its id, number of ids and the offset of its frame in ``payload``.  Parts and
blocks follow ascending doc_id.  A reader needs one block and one frame for one document.
"""

import gc
import hashlib
import itertools
import json
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stationlab.llm.common import encoded, gathered, in_chunks, partitions, texts

END = 1
BLOCK_BYTES = 1 << 20
DICTIONARY_BYTES = 64 << 10
SAMPLE_DOCUMENTS, SAMPLE_BYTES = 1024, 8 << 10
"""The dictionary is trained on so many documents, of the smallest id hashes, and so many bytes of each."""
LEVEL = 3
MEMO_BYTES = 144 << 20
CHUNK_BYTES = 4 << 20
"""Text whose unknown words are encoded together."""
_BLOCKS = (
    "part int, block int, dictionary string, doc_ids array<long>, counts array<long>, "
    "offsets array<long>, n_ids long, payload binary"
)


_CLOSING = frozenset(b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~")
_ENDING = re.compile(rb"(?<=[a-z0-9])([!-&(-/:-@\[-`{-~]+)(?=[\x20\x09-\x0d]|\Z)")


# The parts of a tokenizer file under which a word's ids do not depend on its neighbours.
_NORMAL = ({"type": "NFC"}, {"type": "Lowercase"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "})
_WORDS = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def _apart(raw: dict) -> bool:
    """Whether white space only parts words under this tokenizer file, case aside."""
    normal, before = raw.get("normalizer") or {}, raw.get("pre_tokenizer") or {}
    steps = before.get("pretokenizers") or [{}]
    split = steps[0].get("type") == "Split" and steps[0].get("invert") and steps[0].get("behavior") == "Removed"
    same = split and steps[0]["pattern"] == {"Regex": _WORDS}
    rest = all(x.get("type") == "ByteLevel" and not x.get("use_regex") and not x.get("add_prefix_space") for x in steps[1:])
    kinds = normal.get("normalizers") or []
    return bool(same and rest and {"type": "Lowercase"} in kinds and all(k in _NORMAL for k in kinds))


class Encoder:
    """Whole texts to little-endian 32-bit ids, remembering the ids of words.

    Where the file says that white space only parts words (``_apart``), a word's ids are the same
    wherever it stands; under any other file each text is one word.  When the memory is full, the words
    of the texts at hand that were known already stay.
    """

    def __init__(self, tokenizer: str, memo_bytes: int = MEMO_BYTES):
        from tokenizers import Tokenizer

        with open(tokenizer, encoding="utf-8") as file:
            raw = json.load(file)
        self.tokenizer = Tokenizer.from_file(tokenizer)
        self.apart = _apart(raw)
        self.memo: dict[bytes, int] = {}
        self.flat, self.ends = np.zeros(0, "<u4"), np.zeros(1, np.int64)
        self.held = 0
        self.memo_bytes = memo_bytes
        # A special token stands between words that are encoded together.
        special = [(i, t.content) for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special]
        self.mark_id, self.mark = special[0] if special else (None, None)
        self.plain = self.closing = None
        suffix = raw["model"].get("end_of_word_suffix")
        if self.apart and suffix:
            # Words of lower-case letters need no rewriting, and their last id says so.
            space = {"type": "WhitespaceSplit"}
            raw |= {"normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "Sequence", "pretokenizers": [space, *raw["pre_tokenizer"]["pretokenizers"][1:]]}}
            self.plain = Tokenizer.from_str(json.dumps(raw))
            self.closing = np.zeros(self.plain.get_vocab_size(), bool)
            self.closing[[i for x, i in self.plain.get_vocab().items() if x.endswith(suffix)]] = True

    def __call__(self, batch: list[bytes]) -> Iterator[bytes]:
        for some in in_chunks(batch, CHUNK_BYTES):
            # Long lists of words and no cycles: the collector would walk them over and over.
            collects = gc.isenabled()
            gc.disable()
            try:
                raw, cuts = self._encode(some)
            finally:
                if collects:
                    gc.enable()
            yield from (raw[a:b] for a, b in zip(cuts, cuts[1:]))

    def _encode(self, some: list[bytes]) -> tuple[bytes, list[int]]:
        """All ids of the texts, and where each text's begin and end."""
        # The tokenizer lowers letters itself; a text that may hold a special token stays as it is.
        lowered = [x if b"<|" in x else x.lower() for x in some] if self.apart else some
        split = [x.split() for x in lowered] if self.apart else [[x] if x else [] for x in some]
        words = list(itertools.chain.from_iterable(split))
        places = np.fromiter(map(self.memo.get, words, itertools.repeat(-1)), np.int64, len(words))
        if self.held > self.memo_bytes:
            again = np.unique(places[places >= 0])
            kept = list(self.memo)
            self.flat, self.ends = gathered(self.flat, self.ends, again)
            self.memo = {kept[i]: k for k, i in enumerate(again.tolist())}
            self.held = 170 * len(again) + sum(map(len, self.memo)) + 4 * len(self.flat)
            places = np.where(places < 0, -1, np.searchsorted(again, places))
        unknown = np.flatnonzero(places < 0)
        missing = list(map(words.__getitem__, unknown.tolist()))
        self._learn(dict.fromkeys(missing))
        places[unknown] = np.fromiter(map(self.memo.__getitem__, missing), np.int64, len(missing))
        ids, ends = gathered(self.flat, self.ends, places)
        return ids.tobytes(), (4 * ends[np.cumsum([0, *map(len, split)])]).tolist()

    def _learn(self, missing: dict[bytes, None]) -> None:
        """Remember words.  Punctuation that ends a word is encoded apart from it, as the tokenizer does."""
        parts = {}
        if self.apart:
            closed = [x for x in missing if x[-1] in _CLOSING and b"<|" not in x]
            parts = {x: cut for x in closed if len(cut := _ENDING.sub(rb" \1", x).split()) > 1}
        whole = dict.fromkeys(x for x in missing if x not in parts) if parts else missing
        whole |= dict.fromkeys(w for cut in parts.values() for w in cut if w not in self.memo)
        easy: tuple[list, list] = [], []
        hard: tuple[list, list] = [], []
        for x in whole:
            w = x.decode("utf-8", "replace")
            simple = x.islower() and x.isalpha() or w.isalpha() and w == w.lower() and unicodedata.is_normalized("NFC", w)
            kind = easy if simple and self.plain is not None else hard
            kind[0].append(x)
            kind[1].append(w)
        found = []
        for (_, some), encode in ((easy, self._letters), (hard, self._ids)):
            found += [encode(some[i : i + 2000]) for i in range(0, len(some), 2000)]
        if found:
            self._keep(easy[0] + hard[0], np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]))
        if parts:
            places = [self.memo[w] for cut in parts.values() for w in cut]
            ids, ends = gathered(self.flat, self.ends, np.array(places))
            self._keep(list(parts), ids, np.diff(ends[np.cumsum([0, *map(len, parts.values())])]))

    def _keep(self, words: list[bytes], ids: np.ndarray, sizes: np.ndarray) -> None:
        at = len(self.memo)
        self.memo.update(zip(words, range(at, at + len(words)), strict=True))
        self.flat = np.concatenate([self.flat, ids])
        self.ends = np.append(self.ends, self.ends[-1] + np.cumsum(sizes))
        self.held += 170 * len(words) + sum(map(len, words)) + 4 * len(ids)

    def _letters(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = np.array(self.plain.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        last = np.flatnonzero(self.closing[ids])
        return (ids, np.diff(last, prepend=-1)) if len(last) == len(words) else self._ids(words)

    def _ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words and how many each has."""
        if self.mark and self.apart:
            joined = self.tokenizer.encode_batch_fast([f" {self.mark} ".join(words)], add_special_tokens=False)
            ids = np.array(joined[0].ids, "<u4")
            cuts = np.flatnonzero(ids == self.mark_id)
            if len(cuts) == len(words) - 1:
                return np.delete(ids, cuts), np.diff([-1, *cuts, len(ids)]) - 1
        found = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        return np.fromiter(itertools.chain.from_iterable(found), "<u4"), np.array([len(x) for x in found], np.int64)


_ENCODERS: dict[str, Encoder] = {}


def encoder(tokenizer: str, memo_bytes: int = MEMO_BYTES) -> Encoder:
    """One encoder per worker process and tokenizer file, kept between tasks."""
    if tokenizer not in _ENCODERS:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _ENCODERS[tokenizer] = Encoder(tokenizer)
    _ENCODERS[tokenizer].memo_bytes = memo_bytes
    return _ENCODERS[tokenizer]


def train_dictionary(docs: DataFrame, tokenizer: str, memo_bytes: int = MEMO_BYTES) -> bytes:
    """A dictionary from a bounded sample of serialized id arrays; raw content if training has too little."""

    def sample(batches):
        encode = encoder(tokenizer, memo_bytes)
        for batch in batches:
            found = [x[:SAMPLE_BYTES] for x in encode(encoded(batch.column("text")))]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], names=["ids"])

    # Ids are chosen before texts move; of an id that repeats without bound, the first texts by hash.
    order = F.xxhash64("doc_id"), F.col("doc_id")
    ids = docs.select("doc_id").orderBy(*order).limit(SAMPLE_DOCUMENTS).distinct().withColumnRenamed("doc_id", "_id")
    chosen = texts(docs).join(F.broadcast(ids), F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    some = chosen.mapInArrow(sample, "ids binary").orderBy(F.xxhash64("ids"), "ids").limit(SAMPLE_DOCUMENTS)
    samples = [bytes(r.ids) for r in some.collect() if r.ids]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICTIONARY_BYTES]


def digest(dictionary: bytes) -> str:
    return hashlib.sha256(dictionary).hexdigest()


def _dictionary(raw: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(raw) if raw else None


def write(
    docs: DataFrame,
    folder: str,
    tokenizer: str,
    end: int = END,
    block_bytes: int = BLOCK_BYTES,
    memo_bytes: int = MEMO_BYTES,
) -> None:
    """Write the ids of all whole texts, an ``end`` id after each, in ascending doc_id order.

    Null texts count as empty; null ids come first; rows of one id follow each other by a hash of the text.
    No rows write no blocks.  A text longer than a block has a block of its own.  A worker
    remembers words of about ``memo_bytes``; fewer cost time, never results.
    """
    spark = docs.sparkSession
    raw = train_dictionary(docs, tokenizer, memo_bytes)
    named = digest(raw)
    spark.createDataFrame([(named, raw)], "hash string, bytes binary").coalesce(1).write.parquet(f"{folder}/dictionary")
    shared = spark.sparkContext.broadcast(raw)
    tail = np.array([end], "<u4").tobytes()

    def run(batches):
        encode, book = encoder(tokenizer, memo_bytes), _dictionary(shared.value)
        press = zstandard.ZstdCompressor(level=LEVEL, dict_data=book, write_content_size=True)
        part, number, ids, counts, frames, size = TaskContext.get().partitionId(), 0, [], [], [], 0

        def block():
            offsets = [0, *itertools.accumulate(map(len, frames))]
            return pa.RecordBatch.from_pylist(
                [{"part": part, "block": number, "dictionary": named, "doc_ids": ids, "counts": counts, "offsets": offsets, "n_ids": sum(counts), "payload": b"".join(frames)}],
                schema=pa.schema(
                    [("part", pa.int32()), ("block", pa.int32()), ("dictionary", pa.string())]
                    + [(x, pa.list_(pa.int64())) for x in ("doc_ids", "counts", "offsets")]
                    + [("n_ids", pa.int64()), ("payload", pa.binary())]
                ),
            )

        for batch in batches:
            for doc, found in zip(batch.column("doc_id").to_pylist(), encode(encoded(batch.column("text"))), strict=True):
                ids.append(doc)
                counts.append(len(found) // 4 + 1)
                frames.append(press.compress(found + tail))
                size += len(found) + 4
                if size >= block_bytes:
                    yield block()
                    number, ids, counts, frames, size = number + 1, [], [], [], 0
        if ids:
            yield block()

    # The hash lets rows that share an id, or have none, go to several tasks.
    keyed = texts(docs).withColumn("_hash", F.xxhash64("text"))
    ordered = keyed.repartitionByRange(partitions(docs), "doc_id", "_hash").sortWithinPartitions("doc_id", "_hash", "text")
    ordered.select("doc_id", "text").mapInArrow(run, _BLOCKS).write.parquet(f"{folder}/blocks")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Per document of a folder: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    Starts come from the counts of blocks: totals of parts, then of the blocks of a part.
    """
    rows = spark.read.parquet(f"{folder}/dictionary").collect()
    raw = bytes(rows[0]["bytes"])
    if digest(raw) != rows[0]["hash"]:
        raise ValueError(f"the dictionary of {folder} is not the one it was written with")
    shared = spark.sparkContext.broadcast((rows[0]["hash"], raw))
    blocks = spark.read.schema(_BLOCKS).parquet(f"{folder}/blocks")
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("part", before.alias("_part_start"))
    in_part = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        blocks.select("part", "block", F.coalesce(F.sum("n_ids").over(in_part), F.lit(0)).alias("_start"))
        .join(parts, "part")
        .select("part", "block", (F.col("_start") + F.col("_part_start")).alias("_start"))
    )

    def run(batches):
        named, book = shared.value[0], _dictionary(shared.value[1])
        expand = zstandard.ZstdDecompressor(dict_data=book)
        for batch in batches:
            for b in batch.to_pylist():
                if b["dictionary"] != named:
                    raise ValueError("a block was written with another dictionary")
                crcs = []
                for i, n in enumerate(b["counts"]):
                    got = expand.decompress(b["payload"][b["offsets"][i] : b["offsets"][i + 1]])
                    if len(got) != 4 * n:
                        raise ValueError("a document's ids are cut short")
                    crcs.append(zlib.crc32(got))
                own = np.r_[0, np.cumsum(b["counts"])[:-1]].astype(np.int64)
                m = len(crcs)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b["part"]] * m, pa.int32()), pa.array([b["block"]] * m, pa.int32()), pa.array(b["doc_ids"], pa.int64()), pa.array(own), pa.array(b["counts"], pa.int64()), pa.array(crcs, pa.int64())],
                    names=["part", "block", "doc_id", "own", "n_tokens", "ids_crc32"],
                )

    decoded = blocks.mapInArrow(run, "part int, block int, doc_id long, own long, n_tokens long, ids_crc32 long")
    return decoded.join(starts, ["part", "block"]).select(
        "doc_id", (F.col("_start") + F.col("own")).alias("start"), "n_tokens", "ids_crc32"
    )


def document(spark: SparkSession, folder: str, doc_id: int) -> list[list[int]]:
    """The ids of each document of that id: its block is found by its list of ids, one frame is expanded."""
    rows = spark.read.parquet(f"{folder}/dictionary").collect()
    expand = zstandard.ZstdDecompressor(dict_data=_dictionary(bytes(rows[0]["bytes"])))
    found = (
        spark.read.schema(_BLOCKS)
        .parquet(f"{folder}/blocks")
        .filter(F.array_contains("doc_ids", F.lit(doc_id).cast("long")))
        .select("part", "block", F.posexplode("doc_ids").alias("i", "id"), "offsets", "payload")
        .filter(F.col("id") == doc_id)
        .orderBy("part", "block", "i")
        .select(F.expr("substring(payload, int(offsets[i]) + 1, int(offsets[i + 1] - offsets[i]))").alias("frame"))
    )
    return [np.frombuffer(expand.decompress(bytes(r.frame)), "<u4").tolist() for r in found.collect()]
