"""Benchmark decontamination: a BM25 index of the test items, queried by every training passage.

The index is searched with block-max WAND; what it finds above the threshold is verified by
the words of question and answer that the passage holds in order.
"""

import bisect
import dataclasses
import math
import string
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationlab.llm.common import encoded, texts

K1, B = 1.2, 0.75
THRESHOLD = 0.6
"""Share of an item's own score (its text as the query) that a passage must reach."""
OVERLAP = 0.8
"""Share of the words of the question, and of the answer, that must stand in the passage in order."""
BLOCK = 4
"""Items in a block with its own maxima."""
SPREAD = 2
"""A match may stretch over so many times the item's words."""
PASSAGE = 128
PASSAGES = 256
"""Passages bounded at a time."""
SHARD_BYTES = 16 << 20
"""Item text indexed, and sent to the executors, at a time."""
MEMO = 300_000


def term(word: str) -> str:
    """A lower-case word without punctuation around it; a word of punctuation alone stays."""
    return word.strip(string.punctuation) or word


def terms(text: str) -> list[str]:
    return [term(w) for w in text.lower().split()]


def question_and_answer(words: list[str], raw: str) -> tuple[list[str], list[str]]:
    """The answer is the last sentence, or the last quarter of a single sentence."""
    marks = [i for i, w in enumerate(raw.split()) if w[-1:] in ".?!:"]
    cuts = [i + 1 for i in marks if i + 1 < len(words)]
    at = cuts[-1] if cuts else len(words) - max(1, len(words) // 4)
    return words[:at], words[at:]


def in_order(part: np.ndarray, passage: np.ndarray) -> float:
    """Length of the longest common subsequence over the length of ``part``; 1 for an empty part."""
    if not len(part):
        return 1.0
    best = np.zeros(len(passage) + 1, np.int32)
    for t in part:
        best[1:] = np.maximum.accumulate(np.maximum(best[1:], np.where(passage == t, best[:-1] + 1, 0)))
    return float(best[-1] / len(part))


def held(parts: list[np.ndarray], passage: np.ndarray, overlap: float) -> tuple[float, float, int] | None:
    """(question share, answer share, first word) of the best stretch that holds enough of both, or None.

    Stretches are ``SPREAD`` times as long as the item and a quarter of the item apart, so words scattered more widely are no match.
    """
    size = sum(map(len, parts))
    width, step = SPREAD * size, max(1, size // 4)
    found = np.r_[0, np.cumsum(np.isin(passage, np.concatenate(parts)))]
    starts = np.arange(0, max(1, len(passage) - width + step), step)
    counts = found[np.minimum(starts + width, len(passage))] - found[starts]
    best = None
    for s in starts[counts >= overlap * max(map(len, parts)) - 1e-9]:
        question = in_order(parts[0], passage[s : s + width])
        answer = in_order(parts[1], passage[s : s + width]) if question >= overlap else 0.0
        if answer >= overlap and (best is None or question + answer > best[0] + best[1]):
            best = question, answer, int(s)
            if question == answer == 1.0:
                break
    return best


@dataclasses.dataclass
class Index:
    """Postings by term, items in ascending order; impacts are shares of the item's own score."""

    ids: list[int]
    vocabulary: dict[str, int]
    items: list[list[np.ndarray]]
    docs: list[list[int]]
    impacts: list[list[float]]
    bounds: np.ndarray
    block_at: np.ndarray
    blocks: np.ndarray
    maxima: np.ndarray

    @classmethod
    def build(cls, items: list[tuple[int, str]], known: dict[str, int], n: int, mean: float) -> "Index":
        """``known``: in how many of all ``n`` items a term is; ``mean``: their mean length."""
        vocabulary: dict[str, int] = {}
        docs, impacts, kept, ids = [], [], [], []
        for item, text in items:
            words = terms(text)
            if not words:
                continue
            tf = Counter(words)
            weigh = {
                t: math.log(1 + (n - known[t] + 0.5) / (known[t] + 0.5))
                * c * (K1 + 1) / (c + K1 * (1 - B + B * len(words) / mean))
                for t, c in tf.items()
            }
            own = sum(weigh.values())
            for t, x in weigh.items():
                at = vocabulary.setdefault(t, len(vocabulary))
                if at == len(docs):
                    docs.append([])
                    impacts.append([])
                docs[at].append(len(ids))
                impacts[at].append(x / own)
            kept.append([np.array([vocabulary[t] for t in p], np.int32) for p in question_and_answer(words, text)])
            ids.append(item)
        # Per term, the blocks of items that hold it and its largest impact in each.
        block_at, blocks, maxima = [0, 0], [], []
        for d, x in zip(docs, impacts, strict=True):
            own: dict[int, float] = {}
            for i, y in zip(d, x, strict=True):
                own[i // BLOCK] = max(own.get(i // BLOCK, 0.0), y)
            blocks += own.keys()
            maxima += own.values()
            block_at.append(len(blocks))
        return cls(
            ids, vocabulary, kept, docs, impacts, np.array([max(x) for x in impacts]),
            np.array(block_at), np.array(blocks, np.int64), np.array(maxima),
        )

    def live_blocks(self, passage: np.ndarray, word: np.ndarray, n: int, threshold: float):
        """(passage, block) where the block maxima of the passage's distinct terms reach ``threshold``.

        ``passage`` and ``word`` (one more than the term) are given side by side, for ``n`` passages.
        """
        pairs = np.unique(passage * np.int64(len(self.block_at)) + word)
        passage, word = pairs // len(self.block_at), pairs % len(self.block_at)
        size = self.block_at[word + 1] - self.block_at[word]
        at = np.repeat(self.block_at[word] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
        width = -(-len(self.ids) // BLOCK)
        reach = np.bincount(np.repeat(passage, size) * width + self.blocks[at], self.maxima[at], n * width)
        return np.divmod(np.flatnonzero(reach >= threshold - 1e-9), width)

    def search(self, query: list[int], live: np.ndarray, threshold: float) -> list[tuple[int, float]]:
        """All items whose score for the query's terms reaches ``threshold``: WAND over the live blocks.

        Cursors are kept by their current item.  The pivot is the first item that the bounds
        of the terms up to it could lift to the threshold; a pivot in a dead block moves on
        to the next live one.
        """
        lists = sorted([self.docs[t][0], t, 0] for t in query)
        found = []
        while lists:
            total, pivot = 0.0, -1
            for i, x in enumerate(lists):
                total += self.bounds[x[1]]
                if total >= threshold - 1e-9:
                    pivot = i
                    break
            if pivot < 0:
                break
            item = lists[pivot][0]
            next_live = np.searchsorted(live, item // BLOCK)
            if next_live == len(live):
                break
            if live[next_live] != item // BLOCK:
                target = int(live[next_live]) * BLOCK
            elif lists[0][0] < item:
                target = item  # nothing before the pivot can reach the threshold
            else:
                here = [x for x in lists if x[0] == item]
                score = sum(self.impacts[t][at] for _, t, at in here)
                if score >= threshold - 1e-9:
                    found.append((item, score))
                target = item + 1
            rest = []
            for x in lists:
                if x[0] < target:
                    at = bisect.bisect_left(self.docs[x[1]], target, x[2])
                    if at == len(self.docs[x[1]]):
                        continue
                    x = [self.docs[x[1]][at], x[1], at]
                rest.append(x)
            lists = sorted(rest)
        return found


def by_length(items: list[tuple[int, str]], known: dict[str, int], n: int, mean: float, passage: int) -> list[tuple[int, Index]]:
    """(stride, index) per class of item lengths: a passage never depends on items longer than those it is asked for.

    A stride is ``passage`` or the power of two times it that a match of any item of the class fits into.
    """
    classes: dict[int, list[tuple[int, str]]] = {}
    for item, text in items:
        size = len(terms(text))
        if size:
            wide = max(1, -(-SPREAD * size // passage))
            classes.setdefault(passage << (wide - 1).bit_length(), []).append((item, text))
    return [(stride, Index.build(some, known, n, mean)) for stride, some in sorted(classes.items())]


class Reader(dict):
    """Memo from a lower-case word to one more than its term number, 0 for a word of no item."""

    def __init__(self, vocabulary: dict[str, int]):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, word: str) -> int:
        if len(self) >= MEMO:
            self.clear()
        value = self[word] = self.vocabulary.get(term(word), -1) + 1
        return value


def leaks_in(text: str, index: Index, reader: Reader, passage: int, threshold: float, overlap: float):
    """(item number, score, question share, answer share, first word) of the leaks of one text, best passage each."""
    words = text.lower().split()
    if not words or not index.ids:
        return []
    ids = np.fromiter(map(reader.__getitem__, words), np.int64, len(words))
    stride = passage
    n = max(1, -(-(len(words) - stride) // stride))
    best: dict[int, tuple] = {}
    for low in range(0, n, PASSAGES):
        many = min(PASSAGES, n - low)
        # A word stands in the passage of its stride and in the one before.
        where = np.flatnonzero(ids[low * stride : (low + many + 1) * stride])
        word, own = ids[low * stride + where], where // stride
        passages = np.r_[own[own < many], own[own > 0] - 1]
        found = index.live_blocks(passages, np.r_[word[own < many], word[own > 0]], many, threshold)
        for p in np.unique(found[0]):
            start = int(low + p) * stride
            here = ids[start : start + 2 * stride] - 1
            for item, score in index.search(np.unique(here[here >= 0]).tolist(), found[1][found[0] == p], threshold):
                match = held(index.items[item], here, overlap)
                if match:
                    best[item] = max(best.get(item, ()), (score, *match[:2], -start - match[2]))
    return [(i, a, q, z, -s) for i, (a, q, z, s) in sorted(best.items())]


def _shards(items: DataFrame, shard_bytes: int):
    """The items in lists of bounded text size, with the statistics over all of them."""
    clean = (
        items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
        .filter("item_id IS NOT NULL")
        .groupBy("item_id", "text")
        .count()
        .drop("count")
    )
    size = clean.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    n = max(1, -(-size // shard_bytes))

    def split(batches):
        for batch in batches:
            words = [terms(x.decode("utf-8", "replace")) for x in encoded(batch.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([sorted(set(w)) for w in words], pa.list_(pa.string())), pa.array([len(w) for w in words], pa.int64())],
                names=["terms", "length"],
            )

    if n == 1:
        rows = [(r.item_id, r.text) for r in clean.orderBy("item_id", "text").collect()]
        words = [terms(t) for _, t in rows]
        known = Counter(t for w in words for t in set(w))
        lengths = [len(w) for w in words if w]
        yield rows, known, len(lengths), sum(lengths) / max(1, len(lengths))
        return
    counted = clean.select("text").mapInArrow(split, "terms array<string>, length long").filter("length > 0")
    total, mean = counted.agg(F.count("*"), F.avg("length")).first()
    frequency = counted.select(F.explode("terms").alias("term")).groupBy("term").count()
    for i in range(n):
        part = clean.filter(F.pmod(F.xxhash64("item_id"), F.lit(n)) == i)
        rows = [(r.item_id, r.text) for r in part.orderBy("item_id", "text").collect()]
        own = part.select("text").mapInArrow(split, "terms array<string>, length long")
        own = own.select(F.explode("terms").alias("term")).distinct()
        known = {r.term: r["count"] for r in frequency.join(own, "term").collect()}
        yield rows, known, total, mean


def leaks(
    docs: DataFrame,
    items: DataFrame,
    passage: int = PASSAGE,
    threshold: float = THRESHOLD,
    overlap: float = OVERLAP,
    shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap, first_word) of each leaked item.

    Items are indexed by class of length.  For each class every text is cut into overlapping passages, ``passage`` words
    apart (or that times a power of two) and twice as long, so that a match of any item of the class stands whole in one.
    Each passage queries its index.  What it finds is verified: enough words of question and of answer, in order, in
    a stretch of twice the item's length.  No shuffle; the index is sent in shards of bounded size,
    each with the statistics of all items.  Null and empty texts, items without words and
    null item ids leak nothing; equal items are one, an id with two texts is two items;
    a repeated document repeats its rows.  Other columns are ignored.
    """
    found = None
    for rows, known, n, mean in _shards(items, shard_bytes):
        index = docs.sparkSession.sparkContext.broadcast(by_length(rows, known, n, mean or 1.0, passage))
        part = texts(docs).mapInArrow(
            _runner(index, threshold, overlap),
            "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, first_word long",
        )
        found = part if found is None else found.union(part)
    return found


def _runner(shared, threshold: float, overlap: float):
    def run(batches):
        classes = [(stride, index, Reader(index.vocabulary)) for stride, index in shared.value]
        for batch in batches:
            rows = [
                (doc, index.ids[i], score, q, a, s)
                for doc, text in zip(batch.column("doc_id").to_pylist(), encoded(batch.column("text")), strict=True)
                for stride, index, reader in classes
                for i, score, q, a, s in leaks_in(text.decode("utf-8", "replace"), index, reader, stride, threshold, overlap)
            ]
            columns = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int64(),) * 2 + (pa.float64(),) * 3 + (pa.int64(),), strict=True)],
                names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap", "first_word"],
            )

    return run
