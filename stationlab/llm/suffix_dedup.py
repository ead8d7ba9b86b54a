"""Removal of repeated passages by a collection Burrows-Wheeler transform built column by column.

A string of ``SPAN`` bytes that starts in two places has, in both, the same least k-gram (by
hash, the leftmost of equals).  Windows that follow each other and share theirs make a
segment.  Segments whose k-gram occurs once hold no repeat; of the others, equal ones count
as one with a multiplicity, and all of a k-gram's segments meet in one bucket.

A bucket sorts the suffixes of its segments by inserting one symbol per document each round,
from the ends to the fronts.  Symbols are ``SYMBOL`` bytes wide and a segment is as many
documents, one per starting byte, so that every byte starts a suffix and rounds are few;
symbols are ordered by a 64-bit hash of their bytes, as any order brings equals together.  A
new suffix is its symbol and the place of its tail in the list so far; sorted keys of
(symbol, tail) say where it goes, and the common prefixes with its neighbours are updated.
In the end, suffixes that share ``SPAN`` bytes stand side by side.  A segment that no other
content shares its k-gram with is not inserted: only its own copies repeat it.

Buckets are as many as the text asks for, and a bucket sorts a bounded number of bytes at a
time, k-gram by k-gram.  A k-gram with more is split by place: windows that hold it in their
right half share the bytes before it, the others those after it, so each half is grouped by
those bytes and sorted by itself, in halves again where a group is still too large.
"""


import sys

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationlab.llm.common import cut, encoded, texts

SPAN = 200
GRAM = 24
SYMBOL = 40
BLOCK_BYTES = 4 << 20
BUCKETS_PER_PARTITION = 4
BUCKET_BYTES = 8 << 20
"""Text for which there is one more bucket."""
TILE = 1 << 15
COLLECTION_BYTES = 1 << 20
"""Segments that are sorted together; a k-gram of more has its windows told apart by their surroundings."""
MIX = np.uint64(0x9E3779B97F4A7C15)
LOWER = 0 if sys.byteorder == "little" else 1
PLACE_BITS = 30
"""Room for the place inside a block; longer documents are beyond a string's size anyway."""


def packed(x: np.ndarray | bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(x if isinstance(x, bytes) else x.tobytes())


def unpacked(x: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(x), kind)


def tiled(step, x: np.ndarray, reach: int) -> np.ndarray:
    """``step(x)``, of whose values each looks at ``reach`` of ``x``, in tiles that stay in the processor's cache."""
    out = np.zeros(max(0, len(x) - reach + 1), np.uint64)
    for a in range(0, len(out), TILE):
        out[a : a + TILE] = step(x[a : a + TILE + reach - 1])
    return out


def hashed(x: np.ndarray, span: int) -> np.ndarray:
    """64-bit hash of the ``span`` bytes from each place on."""

    def step(x):
        n = len(x) - span + 1
        out = np.zeros(n, np.uint64)
        power, width, h, done = np.full(1, MIX), 1, x.astype(np.uint64) + np.uint64(1), 0
        while True:
            if span & width:
                out *= power
                out += h[done : done + n]
                done += width
            if 2 * width > span:
                break
            h = h[:-width] * power + h[width:]
            power, width = power * power, 2 * width
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        return out ^ (out >> np.uint64(32))

    return tiled(step, x, span)


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` values in a row."""

    def step(x):
        least, span = x, 1
        while 2 * span <= width:
            least, span = np.minimum(least[:-span], least[span:]), 2 * span
        return np.minimum(least[: len(x) - width + 1], least[width - span :])

    return tiled(step, x, width)


def segments(data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, windows, k-gram hash) of the segments of texts that lie end to end."""
    if len(data) < SPAN:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    hashes = hashed(data, GRAM)
    mask = np.uint64((1 << PLACE_BITS) - 1)
    least = sliding_least((hashes & ~mask) | np.arange(len(hashes), dtype=np.uint64), SPAN - GRAM + 1)
    at = least & mask
    over = np.minimum(lengths, SPAN - 1)  # windows that leave their text
    whole = np.repeat(np.tile([True, False], len(lengths)), np.stack([lengths - over, over], 1).ravel())[: len(at)]
    turn = at[1:] != at[:-1]
    first = np.flatnonzero(whole & np.r_[True, turn | ~whole[:-1]])
    last = np.flatnonzero(whole & np.r_[turn | ~whole[1:], True])
    return first, last - first + 1, hashes[at[first]]


class Collection:
    """Sorted suffixes of strings, all of at least ``SPAN`` bytes, with common prefixes up to that.

    ``key`` is (symbol, place of the tail plus one), ascending; ``at`` the suffix as a place in
    ``symbols``; ``shared`` the bytes shared with the suffix before.  Symbols that reach over a
    string's end are filled with zeros, which no window of ``SPAN`` bytes gets to see.
    """

    def __init__(self, data: np.ndarray, lengths: np.ndarray):
        starts = np.cumsum(lengths) - lengths
        owner = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
        # Symbols cut short by a string's end are hashed with zeros after it, so each string has its own.
        spaced = np.arange(len(data)) + owner * np.int64(SYMBOL - 1)
        filled = np.zeros(len(data) + len(lengths) * (SYMBOL - 1), np.uint8)
        filled[spaced] = data
        value = hashed(filled, SYMBOL)[spaced]
        del filled, spaced
        ids = np.unique(value, return_inverse=True)[1]
        del value
        # A chain per (string, residue): its symbols side by side, then an end mark of 0.
        offset = np.arange(len(data)) - starts[owner]
        residue = offset % SYMBOL
        chain = owner.astype(np.int64) * SYMBOL + residue
        size = np.bincount(chain, minlength=len(lengths) * SYMBOL)
        first = np.cumsum(size + 1) - size - 1
        self.symbols = np.zeros(len(data) + len(size), np.uint32)
        self.place = first[chain] + offset // SYMBOL
        self.symbols[self.place] = ids + 1
        self.first, self.size = first[size > 0], size[size > 0]
        self.key = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.uint32)
        self.shared = np.zeros(0, np.uint8)
        self._build()

    def _build(self) -> None:
        alive = np.argsort(-self.size, kind="stable")
        ends = self.first + self.size - 1
        tail = np.zeros(len(self.size), np.int64)  # place of the tail, plus one; 0 for none
        for done in range(int(self.size.max(initial=0))):
            alive = alive[: np.searchsorted(-self.size[alive], -done, side="left")]
            spot = ends[alive] - done
            key = (self.symbols[spot].astype(np.uint64) << np.uint64(32)) | tail[alive].astype(np.uint64)
            order = np.argsort(key)
            tail[alive[order]] = self._insert(key[order], spot[order].astype(np.uint32)) + 1

    def _insert(self, key: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Put sorted new suffixes into the list; their places."""
        old = len(self.key)
        slot = np.searchsorted(self.key, key, side="right")
        place = slot + np.arange(len(key))
        kept = np.ones(old + len(key), bool)
        kept[place] = False
        moved = np.zeros(old + 1, np.uint32)  # new place plus one of each old suffix
        moved[1:] = np.flatnonzero(kept)
        moved[1:] += np.uint32(1)
        if old:
            # Keys are two numbers of 32 bits; the lower is the tail's place, which moves.
            tails = self.key.view(np.uint32)[LOWER::2]
            tails[:] = moved[tails]
        own = key.view(np.uint32)[LOWER::2]
        own[:] = moved[own]

        def merged(a, b, kind):
            out = np.empty(len(kept), kind)
            out[kept], out[place] = a, b
            return out

        self.key = merged(self.key, key, np.uint64)
        self.at = merged(self.at, at, np.uint32)
        self.shared = merged(self.shared, np.zeros(len(key), np.uint8), np.uint8)
        touched = ~kept
        touched[1:] |= touched[:-1]
        touched[0] = False
        fresh = np.flatnonzero(touched)
        self.shared[fresh] = self._common(self.at[fresh - 1], self.at[fresh])
        return place

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Bytes of whole symbols that two suffixes share, ``SPAN`` at most."""
        out = np.zeros(len(a), np.int64)
        live = np.arange(len(a))
        a, b = a.astype(np.int64), b.astype(np.int64)
        for step in range(-(-SPAN // SYMBOL)):
            x, y = self.symbols[a], self.symbols[b]
            same = (x == y) & (x > 0)
            live, a, b = live[same], a[same] + 1, b[same] + 1
            out[live] = (step + 1) * SYMBOL
            if not len(live):
                break
        return np.minimum(out, SPAN).astype(np.uint8)

    def transform(self) -> np.ndarray:
        """The collection's Burrows-Wheeler transform: the symbol before each suffix, 0 at a front."""
        at = self.at.astype(np.int64)
        return np.where(at > 0, self.symbols[at - 1], 0)

    def repeated(self, lengths: np.ndarray, times: np.ndarray) -> np.ndarray:
        """Per byte of the strings: whether a window of ``SPAN`` bytes starts there that starts elsewhere, too.

        String i stands for ``times[i]`` equal ones.
        """
        starts = np.cumsum(lengths) - lengths
        left = np.repeat(starts + lengths, lengths) - np.arange(int(lengths.sum()))
        weight = np.where(left >= SPAN, np.repeat(times, lengths), 0)
        by_place = np.zeros(len(self.symbols), np.int64)
        by_place[self.place] = weight
        own = by_place[self.at]
        run = np.cumsum(self.shared < SPAN)
        total = np.bincount(run, own)
        hit = np.zeros(len(self.symbols), bool)
        hit[self.at] = (own > 0) & (total[run] > 1)
        return hit[self.place]


def repeats(strings: list[bytes], times: np.ndarray, grams: np.ndarray, limit: int = COLLECTION_BYTES) -> list[np.ndarray]:
    """Per string, which windows of ``SPAN`` bytes start elsewhere, too; string i stands for ``times[i]`` equal ones.

    ``grams`` are the hashes of the k-grams that the strings share; equal windows have the same.
    """
    out: list = [None] * len(strings)
    lengths = np.array([len(x) for x in strings], np.int64)
    order = np.argsort(grams, kind="stable")
    some, size = [], 0
    for group in np.split(order, np.flatnonzero(np.diff(grams[order])) + 1):
        members, own = group.tolist(), int(lengths[group].sum())
        if own > limit:
            mine = [strings[i] for i in members]
            anchors = [int(np.argmax(hashed(np.frombuffer(x, np.uint8), GRAM) == grams[members[0]])) for x in mine]
            for i, hit in zip(members, _closer(mine, anchors, times[group].tolist(), 0, SPAN - GRAM, limit), strict=True):
                out[i] = hit
            continue
        some, size = some + members, size + own
        if size > limit:
            for i, hit in zip(some, _sorted([strings[i] for i in some], times[some]), strict=True):
                out[i] = hit
            some, size = [], 0
    for i, hit in zip(some, _sorted([strings[i] for i in some], times[some]) if some else [], strict=True):
        out[i] = hit
    return out


def _sorted(strings: list[bytes], times: np.ndarray) -> list[np.ndarray]:
    lengths = np.array([len(x) for x in strings], np.int64)
    found = Collection(np.frombuffer(b"".join(strings), np.uint8), lengths).repeated(lengths, np.asarray(times, np.int64))
    ends = np.cumsum(lengths).tolist()
    return [found[e - len(x) : e - SPAN + 1] for e, x in zip(ends, strings, strict=True)]


def _closer(strings: list[bytes], anchors: list[int], times: list[int], low: int, high: int, limit: int) -> list[np.ndarray]:
    """``repeats`` of strings with one k-gram at ``anchors``, for windows that begin ``low`` to ``high`` bytes before it.

    Halves of that range are grouped by the bytes that all their windows hold, and sorted apart.
    """
    out = [np.zeros(len(x) - SPAN + 1, bool) for x in strings]
    middle = (low + high + 1) // 2
    for near, far in ((low, middle - 1), (middle, high)):
        groups: dict[bytes, dict[bytes, list[tuple[int, int]]]] = {}
        for i, (x, p) in enumerate(zip(strings, anchors, strict=True)):
            first, last = max(0, p - far), min(len(x) - SPAN, p - near)
            if first <= last:
                common = x[p - near : p - far + SPAN]
                groups.setdefault(common, {}).setdefault(x[first : last + SPAN], []).append((i, first))
        some: list[tuple[bytes, list[tuple[int, int]]]] = []
        size = 0

        def told(part: bytes, where: list[tuple[int, int]], hit: np.ndarray):
            for i, first in where:
                out[i][first : first + len(part) - SPAN + 1] = hit

        def finish(parts):
            weights = [sum(times[i] for i, _ in where) for _, where in parts]
            for (part, where), hit in zip(parts, _sorted([x for x, _ in parts], np.array(weights)), strict=True):
                told(part, where, hit)

        for group in groups.values():
            own = sum(map(len, group))
            if len(group) == 1:
                ((part, where),) = group.items()
                told(part, where, np.full(len(part) - SPAN + 1, sum(times[i] for i, _ in where) > 1))
            elif own > limit:
                parts = list(group.items())
                weights = [sum(times[i] for i, _ in where) for _, where in parts]
                places = [anchors[where[0][0]] - where[0][1] for _, where in parts]
                found = _closer([x for x, _ in parts], places, weights, near, far, limit)
                for (part, where), hit in zip(parts, found, strict=True):
                    told(part, where, hit)
            else:
                some += group.items()
                size += own
                if size > limit:
                    finish(some)
                    some, size = [], 0
        if some:
            finish(some)
    return out


_BLOCKS = "block long, size long, doc_ids binary, nulls binary, lengths binary, data binary, first binary, windows binary, hashes binary"


def _blocks(docs: DataFrame, block_bytes: int) -> DataFrame:
    def run(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            rows = list(zip(batch.column("doc_id").to_pylist(), encoded(batch.column("text")), strict=True))
            size = np.cumsum([len(t) for _, t in rows])
            for _, members in pd.Series(range(len(rows))).groupby((size - 1) // block_bytes):
                chunk = [rows[i] for i in members]
                lengths, data = np.array([len(t) for _, t in chunk], np.int64), b"".join(t for _, t in chunk)
                first, windows, hashes = segments(np.frombuffer(data, np.uint8), lengths)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x]) for x in (
                        number,
                        len(data),
                        packed(np.array([d or 0 for d, _ in chunk], np.int64)),
                        packed(np.array([d is None for d, _ in chunk], np.uint8)),
                        packed(lengths),
                        packed(data),
                        packed(np.diff(first, prepend=0).astype(np.uint32)),
                        packed(windows.astype(np.uint16)),
                        packed(hashes),
                    )],
                    names=[x.split()[0] for x in _BLOCKS.split(", ")],
                )
                number += 1

    return cut(texts(docs).mapInArrow(run, _BLOCKS))


def _per_bucket(block: int, buckets: int, hashes: np.ndarray, columns) -> pa.RecordBatch:
    """Rows (bucket, block, packed columns); ``columns`` gives them for the numbers of a bucket's hashes."""
    bucket = (hashes % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
    out = [(int(k), block, *map(packed, columns(order[ends[k] : ends[k + 1]]))) for k in np.flatnonzero(np.diff(ends))]
    width = len(columns(order[:0]))
    names = ["bucket", "block", *(f"c{i}" for i in range(width))]
    schema = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), *((n, pa.binary()) for n in names[2:])])
    return pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in out], schema=schema)


class _Block:
    """A block read back, with its segments and their distinct k-gram hashes."""

    def __init__(self, row: dict, buckets: int):
        self.doc_ids, self.nulls = unpacked(row["doc_ids"], "i8"), unpacked(row["nulls"], "u1")
        self.lengths, self.data = unpacked(row["lengths"], "i8"), unpacked(row["data"], "u1")
        self.first = np.cumsum(unpacked(row["first"], "u4"), dtype=np.int64)
        self.windows, self.hashes = unpacked(row["windows"], "u2").astype(np.int64), unpacked(row["hashes"], "u8")
        self.distinct, self.of, self.times = np.unique(self.hashes, return_inverse=True, return_counts=True)
        self.buckets = buckets

    def in_order(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of the hashes in the order in which the buckets answer."""
        return np.argsort((hashes % np.uint64(self.buckets)).astype(np.int64), kind="stable")

    def contents(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the wanted segments: each one's class of equal content, and per class a segment and the size."""
        raw = self.data.tobytes()
        seen: dict[bytes, int] = {}
        of = np.array(
            [seen.setdefault(raw[a : a + n + SPAN - 1], len(seen)) for a, n in zip(self.first[wanted].tolist(), self.windows[wanted].tolist(), strict=True)],
            np.int64,
        )
        _, one = np.unique(of, return_index=True)
        return of, wanted[one], np.bincount(of, minlength=len(one))


def _flags(blocks: DataFrame, buckets: int) -> DataFrame:
    """Per (block, bucket): which of the block's distinct k-grams occur twice or more in all."""

    def ask(batches):
        for batch in batches:
            for row in batch.to_pylist():
                b = _Block(row, buckets)
                yield _per_bucket(row["block"], buckets, b.distinct, lambda i, b=b: (b.distinct[i], np.minimum(b.times[i], 2).astype(np.uint8)))

    def answer(table):
        rows = table.to_pylist()
        hashes, times = [unpacked(r["c0"], "u8") for r in rows], [unpacked(r["c1"], "u1") for r in rows]
        _, of = np.unique(np.concatenate(hashes), return_inverse=True)
        often = np.bincount(of, np.concatenate(times)) > 1
        found = np.split(often[of], np.cumsum([len(x) for x in hashes])[:-1])
        return pa.table({"block": [r["block"] for r in rows], "bucket": pa.array([r["bucket"] for r in rows], pa.int32()), "flags": [packed(x) for x in found]})

    asked = blocks.mapInArrow(ask, "bucket int, block long, c0 binary, c1 binary")
    return asked.groupBy("bucket").applyInArrow(answer, "block long, bucket int, flags binary")


def _candidates(b: _Block, answers: pd.DataFrame) -> np.ndarray:
    flags = np.zeros(len(b.distinct), bool)
    if len(answers):
        flags[b.in_order(b.distinct)] = np.concatenate([unpacked(x, "?") for x in answers.sort_values("bucket")["flags"]])
    return np.flatnonzero(flags[b.of])


def _repeats(questions: DataFrame) -> DataFrame:
    """Per (block, bucket): the repeated window starts of the block's distinct segments, in its order."""

    def answer(table):
        rows = table.to_pylist()
        seen: dict[bytes, int] = {}
        of, times, grams = [], [], []
        for r in rows:
            data, lengths = unpacked(r["c0"], "u1").tobytes(), unpacked(r["c1"], "i4").tolist()
            end = np.cumsum(lengths).tolist()
            of.append(np.array([seen.setdefault(data[e - n : e], len(seen)) for e, n in zip(end, lengths, strict=True)], np.int64))
            times.append(unpacked(r["c2"], "i4"))
            grams.append(unpacked(r["c3"], "u8"))
        lengths = np.array([len(x) for x in seen], np.int64)
        counts = np.bincount(np.concatenate(of), np.concatenate(times)).astype(np.int64)
        _, first = np.unique(np.concatenate(of), return_index=True)
        _, gram, contents = np.unique(np.concatenate(grams)[first], return_inverse=True, return_counts=True)
        shared = np.flatnonzero(contents[gram] > 1)
        hit = np.repeat(counts > 1, lengths)
        ends = np.cumsum(lengths)
        strings = list(seen)
        del seen
        found = repeats([strings[i] for i in shared.tolist()], counts[shared], np.concatenate(grams)[first][shared])
        for i, bits in zip(shared.tolist(), found, strict=True):
            hit[ends[i] - lengths[i] : ends[i] - SPAN + 1] = bits
        out = []
        for r, own in zip(rows, of, strict=True):
            bits = [hit[ends[i] - lengths[i] : ends[i] - SPAN + 1] for i in own.tolist()]
            out.append(packed(np.concatenate(bits)))
        return pa.table({"block": [r["block"] for r in rows], "bucket": pa.array([r["bucket"] for r in rows], pa.int32()), "hits": out})

    return questions.groupBy("bucket").applyInArrow(answer, "block long, bucket int, hits binary")


def marked(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, spans (start, end) of the removed runs, kept (the rest).

    A byte goes if a string of ``SPAN`` bytes over it also starts elsewhere in any text, the
    same one and equal rows included.  Texts are UTF-8 bytes; null counts as empty; texts
    shorter than ``SPAN`` keep all.  Matches never cross texts.  No rows give no rows.
    """
    spark = docs.sparkSession
    blocks = _blocks(docs, block_bytes)
    size = blocks.agg(F.sum("size")).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")) * BUCKETS_PER_PARTITION, size // BUCKET_BYTES)
    flags = cut(_flags(blocks, buckets))

    def ask(left, right):
        rows = []
        if len(left):
            b = _Block(left.iloc[0], buckets)
            _, one, size = b.contents(_candidates(b, right))
            spans = [(int(a), int(n)) for a, n in zip(b.first[one], b.windows[one] + SPAN - 1, strict=True)]

            def columns(i):
                cuts = [spans[j] for j in i]
                return (
                    b"".join(b.data[a : a + n].tobytes() for a, n in cuts),
                    np.array([n for _, n in cuts], np.int32),
                    size[i].astype(np.int32),
                    b.hashes[one[i]],
                )

            rows = _per_bucket(int(left["block"].iloc[0]), buckets, b.hashes[one], columns).to_pylist()
        return pd.DataFrame(rows, columns=["bucket", "block", "c0", "c1", "c2", "c3"])

    own = blocks.toDF(*blocks.columns)
    questions = own.groupBy("block").cogroup(flags.groupBy("block")).applyInPandas(
        ask, "bucket int, block long, c0 binary, c1 binary, c2 binary, c3 binary"
    )
    hits = cut(_repeats(questions)).toDF("block", "bucket", "hits")
    answers = flags.withColumn("hits", F.lit(None).cast("binary")).unionByName(
        hits.withColumn("flags", F.lit(None).cast("binary")).select("block", "bucket", "flags", "hits")
    )

    def finish(left, right):
        names = ["doc_id", "n_bytes", "spans", "kept"]
        if not len(left):
            return pd.DataFrame({n: [] for n in names})
        b = _Block(left.iloc[0], buckets)
        wanted = _candidates(b, right[right["flags"].notna()])
        of, one, _ = b.contents(wanted)
        found = right[right["hits"].notna()].sort_values("bucket")["hits"]
        bits = np.concatenate([unpacked(x, "?") for x in found]) if len(found) else np.zeros(0, bool)
        # Where each class's bits are, in the order of the answers.
        order = b.in_order(b.hashes[one])
        at = np.zeros(len(one), np.int64)
        at[order] = np.cumsum(b.windows[one][order]) - b.windows[one][order]
        size = b.windows[wanted]
        ahead = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        starts = (np.repeat(b.first[wanted], size) + ahead)[bits[np.repeat(at[of], size) + ahead]]
        change = np.zeros(len(b.data) + SPAN, np.int32)
        change[starts] = 1
        change[starts + SPAN] -= 1
        gone = np.cumsum(change)[: len(b.data)] > 0
        ends = np.cumsum(b.lengths)
        out = []
        for d, null, n, e in zip(b.doc_ids.tolist(), b.nulls.tolist(), b.lengths.tolist(), ends.tolist(), strict=True):
            mine = gone[e - n : e]
            if mine.any():
                edge = np.flatnonzero(np.diff(np.r_[False, mine, False]))
                out.append((None if null else d, n, edge.tolist(), b.data[e - n : e][~mine].tobytes()))
            else:
                out.append((None if null else d, n, [], b.data[e - n : e].tobytes()))
        frame = pd.DataFrame(out, columns=names)
        frame["doc_id"] = frame["doc_id"].astype("Int64")
        return frame

    again = blocks.toDF(*blocks.columns)
    result = again.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(
        finish, "doc_id long, n_bytes long, spans array<long>, kept binary"
    )
    pairs = F.transform(
        F.sequence(F.lit(0), F.size("spans") - 2, F.lit(2)),
        lambda i: F.struct(F.get("spans", i).alias("start"), F.get("spans", i + 1).alias("end")),
    )
    return result.withColumn("spans", F.when(F.size("spans") > 0, pairs).otherwise(F.array().cast("array<struct<start:long,end:long>>")))


def digests(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return marked(docs, block_bytes).select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
