"""Two tokenizers of one text aligned: groups between common byte ends, links of overlapping tokens, corpus-wide counts.

Both tokenizations of a text end at byte offsets; their merged order is the merge path of two
sorted lists.  Equally spaced diagonals cut the path into pieces of equal work: a binary search
per diagonal (all at once) finds how many ends of either side lie before it.  A piece merges
its own slices only and emits the overlaps of its tokens and the ends both sides share; groups
that cross pieces are stitched by running counts of shared ends.

The corpus is read once.  Each task writes *blocks* of documents of at most ``BLOCK_LINKS`` links
(or one longer document): the distinct links with the number of the block's documents that
hold them, and per document places in that list.  The number of documents of a link is a grouped
sum over blocks; each block asks for the counts of its distinct links, one row a link
however often a document or block repeats it, so a link that every document holds costs a row a block.
"""

import hashlib
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationlab.llm.common import gathered, in_chunks, shared_folder, texts

PIECE = 1 << 14
"""Merged ends of a piece."""
BLOCK_LINKS = 1 << 20
CHUNK_BYTES = 2 << 20
"""Text that is encoded and merged together; a longer text is a chunk of its own."""
MEMO_BYTES = 32 << 20
ROW_LINKS = 1 << 13
"""Distinct links in a stored row."""
_BLOCKS = (
    "block long, doc_ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, "
    "sizes array<long>, digests array<string>, payload binary, links array<long>, held array<int>"
)
_ROWS = (
    "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
)
_RUNS = re.compile(r"\s | \s")
_CUTS = re.compile(r"(?<=\S)(?= \S)")


def byte_alphabet() -> dict[str, int]:
    """The character that byte-level vocabularies write for each byte: printable ones stand for themselves."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class Pair:
    """A byte-level tokenizer (A, of `` `` + text) and a sentencepiece model (B, of text) over whole texts.

    No token of either side spans the place between a character and a single space before
    another one (checked for B's vocabulary), so the stretches between such places are encoded
    once and remembered.  A text with a stretch whose tokens do not spell it is encoded whole.
    """

    def __init__(self, a: str, b: str, memo_bytes: int = MEMO_BYTES):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a)
        self.a.encode_special_tokens = True
        alphabet = byte_alphabet()
        self.bytes_a = [b""] * self.a.get_vocab_size(with_added_tokens=True)
        for token, i in self.a.get_vocab(with_added_tokens=False).items():
            self.bytes_a[i] = bytes(alphabet[c] for c in token)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
            for i, p in enumerate(pieces)
        ]
        self.apart = not any(re.search("[^▁]▁", p) for p in pieces)
        self.width_a = np.array([len(x) for x in self.bytes_a], np.int64)
        self.width_b = np.array([len(x) for x in self.bytes_b], np.int64)
        self.numbers = max(len(self.bytes_a), len(self.bytes_b))
        written = [b"%d" % i + sep for sep in (b",", b"|", b";") for i in range(self.numbers)]
        longest = max(map(len, written))
        self.written = np.frombuffer(b"".join(x.ljust(longest) for x in written), np.uint8).reshape(-1, longest)
        self.letters = np.array([len(x) for x in written])
        self.memo: dict[str, int] = {}
        self.flat = [np.zeros(0, np.uint32), np.zeros(0, np.uint32)]
        self.ends = [np.zeros(1, np.int64), np.zeros(1, np.int64)]
        self.odd: set[str] = set()
        self.held, self.memo_bytes = 0, memo_bytes

    def __call__(self, some: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray] | None]:
        """Per text the ids of A and of B, or None where the text has no tokens."""
        split = [self._stretches(t) if t else [] for t in some]
        known = set().union(*split)
        if self.held > self.memo_bytes:  # the stretches met again stay
            again = [x for x in self.memo if x in known]
            places = np.fromiter(map(self.memo.__getitem__, again), np.int64, len(again))
            cut = [gathered(f, e, places) for f, e in zip(self.flat, self.ends, strict=True)]
            self.flat, self.ends = [c[0] for c in cut], [c[1] for c in cut]
            self.memo = dict(zip(again, range(len(again)), strict=True))
            self.odd &= known
            self.held = 200 * len(again) + sum(map(len, again)) + sum(4 * len(f) for f in self.flat)
        missing = list(known.difference(self.memo))
        found = [self._encode(missing[i : i + 4096]) for i in range(0, len(missing), 4096)]
        self.memo.update(zip(missing, range(len(self.memo), len(self.memo) + len(missing)), strict=True))
        for k in (0, 1):
            self.flat[k] = np.concatenate([self.flat[k], *(f[k] for f in found)])
            sizes = np.concatenate([np.zeros(0, np.int64), *(f[2 + k] for f in found)])
            self.ends[k] = np.append(self.ends[k], self.ends[k][-1] + np.cumsum(sizes))
            self.held += 4 * int(sizes.sum())
        self.odd.update(*(f[4] for f in found))
        self.held += 200 * len(missing) + sum(map(len, missing))
        places = np.fromiter(map(self.memo.__getitem__, itertools.chain.from_iterable(split)), np.int64)
        at = np.cumsum([0, *map(len, split)])
        both = []
        for f, e in zip(self.flat, self.ends, strict=True):
            ids, ends = gathered(f, e, places)
            both.append((ids, ends[at]))
        (a, cut_a), (b, cut_b) = both
        for k, (text, stretches) in enumerate(zip(some, split, strict=True)):
            if not text:
                yield None
            elif self.odd and not self.odd.isdisjoint(stretches):
                first, second, *_, odd = self._encode([text])
                yield None if odd else (first, second)
            else:
                yield a[cut_a[k] : cut_a[k + 1]], b[cut_b[k] : cut_b[k + 1]]

    def _stretches(self, text: str) -> list[str]:
        """Parts of the text, each to be read after a space."""
        if not self.apart:
            return [text]
        if text[0].isspace() or text[-1].isspace() or _RUNS.search(text):
            return [x[1:] for x in _CUTS.split(" " + text)]
        return text.split(" ")

    def _encode(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[str]]:
        """The ids of both sides, their numbers by part, and the parts that one of them does not spell.

        Parts that open and close with a character are encoded in one text: that is how they stand in a text.
        """
        raw = [b" " + x.encode() for x in parts]
        if self.apart and all(x and not x[0].isspace() and not x[-1].isspace() for x in parts):
            whole = " ".join(parts)
            both = self.a.encode_batch_fast([" " + whole], add_special_tokens=False)[0].ids, self.b.encode(whole)
            ends = np.cumsum([len(x) for x in raw])
            cut = []
            for ids, spelling, width in zip(both, (self.bytes_a, self.bytes_b), (self.width_a, self.width_b), strict=True):
                ids = np.array(ids, np.uint32)
                reached = np.cumsum(width[ids])
                last = np.searchsorted(reached, ends)
                if b"".join(map(spelling.__getitem__, ids.tolist())) == b"".join(raw) and (reached[last] == ends).all():
                    cut.append((ids, np.diff(last + 1, prepend=0)))
            if len(cut) == 2:
                return cut[0][0], cut[1][0], cut[0][1], cut[1][1], []
        firsts = [e.ids for e in self.a.encode_batch_fast([" " + x for x in parts], add_special_tokens=False)]
        seconds = self.b.encode(parts, num_threads=1)
        odd = [
            x
            for x, r, p, q in zip(parts, raw, firsts, seconds, strict=True)
            if b"".join(map(self.bytes_a.__getitem__, p)) != r or b"".join(map(self.bytes_b.__getitem__, q)) != r
        ]
        flat = [np.fromiter(itertools.chain.from_iterable(x), np.uint32) for x in (firsts, seconds)]
        return (*flat, *(np.fromiter(map(len, x), np.int64, len(x)) for x in (firsts, seconds)), odd)


def crossings(a: np.ndarray, b: np.ndarray, diagonals: np.ndarray) -> np.ndarray:
    """How many of ``a`` are among the first ``diagonals`` of the merged order of a and b, equal ones a first."""
    low, high = np.maximum(0, diagonals - len(b)), np.minimum(diagonals, len(a))
    while (open_ := low < high).any():
        middle = (low + high) // 2
        take = open_ & (a[np.minimum(middle, len(a) - 1)] <= b[np.clip(diagonals - 1 - middle, 0, len(b) - 1)])
        low = np.where(take, middle + 1, low)
        high = np.where(open_ & ~take, middle, high)
    return low


def merge(a: np.ndarray, b: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Overlaps and shared ends of two lists of byte ends that end alike.

    Returns the overlapping places (i in ``a``, j in ``b``) in no particular order, and the places of shared ends.
    """
    n = len(a) + len(b)
    diagonals = np.append(np.arange(0, n, piece), n)
    cut_a = crossings(a, b, diagonals) if n else diagonals
    cut_b = diagonals - cut_a
    links_a, links_b, ties_a, ties_b = [], [], [], []
    for i0, i1, j0, j1 in zip(cut_a[:-1], cut_a[1:], cut_b[:-1], cut_b[1:], strict=True):
        own, other = a[i0:i1], b[j0:j1]
        j = j0 + np.searchsorted(other, own, "left")
        i = i0 + np.searchsorted(own, other, "right")
        # An end of the first list may meet its equal in the next piece, one of the second in the piece before.
        shared = b[np.minimum(j, len(b) - 1)] == own
        fresh = (i == 0) | (a[i - 1] != other)
        links_a += [np.arange(i0, i1), i[fresh]]
        links_b += [j, np.arange(j0, j1)[fresh]]
        ties_a.append(np.arange(i0, i1)[shared])
        ties_b.append(j[shared])
    joined = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (links_a, links_b, ties_a, ties_b)]
    return tuple(joined)


def _described(pair: Pair, found: list) -> tuple[list, np.ndarray, np.ndarray]:
    """Of texts encoded together: (n_a, n_b, n_groups, n_links, digest) each, and all links as (text, link) arrays."""
    have = [k for k, f in enumerate(found) if f is not None]
    rows: list = [(0, 0, 0, 0, "")] * len(found)
    if not have:
        return rows, np.zeros(0, np.int64), np.zeros(0, np.int64)
    ids_a = np.concatenate([found[k][0] for k in have]).astype(np.int64)
    ids_b = np.concatenate([found[k][1] for k in have]).astype(np.int64)
    a, b = np.cumsum(pair.width_a[ids_a]), np.cumsum(pair.width_b[ids_b])
    i, j, ties_a, ties_b = merge(a, b)
    size_a, size_b = (np.array([len(found[k][s]) for k in have]) for s in (0, 1))
    end_a, end_b = np.cumsum(size_a), np.cumsum(size_b)
    # Groups in order, the tokens of A before those of B, each with what follows it.
    tied_a, tied_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    tied_a[ties_a], tied_b[ties_b] = 1, 1
    at_a = np.arange(len(a)) + np.append(0, ties_b + 1)[np.cumsum(tied_a) - tied_a]
    at_b = np.arange(len(b)) + ties_a[np.cumsum(tied_b) - tied_b] + 1
    text = np.empty(len(a) + len(b), np.int64)
    text[at_a] = ids_a + pair.numbers * tied_a
    text[at_b] = ids_b + 2 * pair.numbers * tied_b
    letters = pair.letters[text]
    written = pair.written[text][np.arange(pair.written.shape[1]) < letters[:, None]].tobytes()
    reached = np.append(0, np.cumsum(letters))
    groups = np.diff(np.searchsorted(ties_a, end_a), prepend=0)
    owner = np.repeat(np.arange(len(have)), size_a)[i]
    n_links = np.bincount(owner, minlength=len(have))
    low = 0
    for x, k in enumerate(have):
        high = int(end_a[x] + end_b[x])
        digest = hashlib.sha256(written[reached[low] : reached[high] - 1]).hexdigest()
        rows[k] = (int(size_a[x]), int(size_b[x]), int(groups[x]), int(n_links[x]), digest)
        low = high
    return rows, np.array(have)[owner], ids_a[i] << 32 | ids_b[j]


_PAIRS: dict[tuple[str, str], Pair] = {}


def _pair(a: str, b: str) -> Pair:
    """One pair of tokenizers per worker process, kept between tasks."""
    if (a, b) not in _PAIRS:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _PAIRS[a, b] = Pair(a, b)
    return _PAIRS[a, b]


def _blocks(a: str, b: str, block_links: int):
    schema = pa.schema(
        [("block", pa.int64())]
        + [(x, pa.list_(pa.int64())) for x in ("doc_ids", "n_a", "n_b", "n_groups", "n_links", "sizes")]
        + [("digests", pa.list_(pa.string())), ("payload", pa.binary())]
        + [("links", pa.list_(pa.int64())), ("held", pa.list_(pa.int32()))]
    )

    def run(batches):
        pair = _pair(a, b)
        press = zstandard.ZstdCompressor(level=1)
        number = TaskContext.get().partitionId() << 32
        ids, rows, parts, n = [], [], [], 0

        def block():
            owner, link = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
            distinct, place = np.unique(link, return_inverse=True)
            entry, times = np.unique(owner * max(1, len(distinct)) + place, return_counts=True)
            place = entry % max(1, len(distinct))
            held = np.bincount(place, minlength=len(distinct)).astype(np.int32)
            sizes = np.bincount(entry // max(1, len(distinct)), minlength=len(ids))
            raw = np.diff(place, prepend=0).astype("<i4").tobytes() + times.astype("<u4").tobytes()
            columns = [list(x) for x in zip(*rows, strict=True)]
            head = {"block": number, "doc_ids": ids, "n_a": columns[0], "n_b": columns[1], "n_groups": columns[2]}
            head |= {"n_links": columns[3], "digests": columns[4], "sizes": sizes, "payload": press.compress(raw)}
            yield pa.RecordBatch.from_pylist([head], schema=schema)
            for low in range(0, len(distinct), ROW_LINKS * 32):
                some = [
                    {"block": number, "links": distinct[k : k + ROW_LINKS], "held": held[k : k + ROW_LINKS]}
                    for k in range(low, min(low + ROW_LINKS * 32, len(distinct)), ROW_LINKS)
                ]
                yield pa.RecordBatch.from_pylist(some, schema=schema)

        for batch in batches:
            names, whole, at = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), 0
            for some in in_chunks(whole, CHUNK_BYTES):
                described, owner, link = _described(pair, list(pair(some)))
                parts.append((owner + len(ids), link))
                ids += names[at : at + len(some)]
                rows += described
                at, n = at + len(some), n + len(link)
                if n >= block_links:
                    yield from block()
                    number, ids, rows, parts, n = number + 1, [], [], [], 0
        if ids:
            yield from block()

    return run


def _rated(key, heads: pa.Table, rates: pa.Table) -> pa.Table:
    """A block's documents with the counts of its distinct links summed."""
    _PAIRS.clear()  # nothing is encoded any more; what it took goes to the counts
    order = np.argsort(rates.column("link").to_numpy())
    rate = rates.column("rate").to_numpy()[order].astype(np.int64)
    count, best = rate >> 1, rate & 1
    head = heads.to_pylist()[0]
    raw = zstandard.ZstdDecompressor().decompress(head["payload"])
    half = len(raw) // 2
    place, times = np.cumsum(np.frombuffer(raw[:half], "<i4").astype(np.int64)), np.frombuffer(raw[half:], "<u4").astype(np.int64)
    owner = np.repeat(np.arange(len(head["sizes"])), head["sizes"])
    sums = np.zeros((2, len(head["sizes"])), np.int64)
    np.add.at(sums[0], owner, times * best[place])
    np.add.at(sums[1], owner, times * count[place])
    names = [x.split(" ")[0] for x in _ROWS.split(", ")]
    columns = [head[x] for x in ("doc_ids", "n_a", "n_b", "n_groups", "n_links")] + [sums[0], sums[1], head["digests"]]
    types = [pa.int64()] * 7 + [pa.string()]
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def align(docs: DataFrame, a: str, b: str, block_links: int = BLOCK_LINKS) -> tuple[DataFrame, DataFrame]:
    """Align tokenizer file ``a`` with model ``b`` over the texts of ``docs`` (doc_id, text).

    Returns the documents (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)
    and the links of the corpus (a_id, b_id, n_docs, best).  A null or empty text, and one that either
    side does not spell, has zeros and an empty digest.  Rows that repeat an id, or have none, are documents
    of their own; ties for the best link all count; no rows give empty tables; other columns are not read.

    The distinct links per A id are reduced to one number each, so the table that is broadcast
    has at most as many rows as A's vocabulary.
    """
    spark = docs.sparkSession
    folder = shared_folder(spark, "alignment")
    texts(docs).mapInArrow(_blocks(a, b, block_links), _BLOCKS).write.option("parquet.block.size", 32 << 20).parquet(folder)
    blocks = spark.read.schema(_BLOCKS).parquet(folder)
    held = blocks.filter("links is not null").select("block", F.inline(F.arrays_zip("links", "held"))).toDF("block", "link", "n")
    counts = held.groupBy("link").agg(F.sum("n").alias("n_docs")).withColumn("a_id", F.shiftright("link", 32).cast("int"))
    most = counts.groupBy("a_id").agg(F.max("n_docs").alias("_most"))
    rated = counts.join(F.broadcast(most), "a_id").withColumn("best", F.col("n_docs") == F.col("_most"))
    asked = held.select("block", "link").join(
        rated.select("link", (F.col("n_docs") * 2 + F.col("best").cast("int")).alias("rate")), "link"
    )
    heads = blocks.filter("payload is not null").drop("links", "held")
    rows = heads.groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(_rated, _ROWS)
    links = rated.select("a_id", F.expr("int(link & 4294967295)").alias("b_id"), "n_docs", "best")
    return rows, links
