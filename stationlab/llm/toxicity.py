"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy."""

import dataclasses
import string
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationlab.llm.common import encoded, fold, in_chunks, texts

GRAMS = (3, 4, 5)
BUCKETS = 1 << 17
DIM = 4
MAX_TRAINING_ROWS = 8_000
"""The bound of the labelled sample: the rows of the smallest id hashes."""
EPOCHS = 12
DECAY = 1e-5
RATE = 0.1
SCALE = 100.0
"""The mean of the word vectors is multiplied by this, so that few words can outweigh many."""
MIN_DOCUMENTS = 4
"""Words of fewer documents of the sample are left out of the fit, not of scoring."""
BATCH = 400
MEMO = 200_000
CHUNK = 1 << 19
"""Characters of text, or of unknown words, worked on at a time."""
MIX = np.uint64(0x9E3779B97F4A7C15)


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the character n-grams of each ``<word>`` and of the whole of it: (buckets, word numbers)."""
    codes = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    size = np.array([len(w) + 2 for w in words], np.int64)
    owner = np.repeat(np.arange(len(words), dtype=np.int32), size)
    end = np.cumsum(size)
    place = np.arange(len(codes)) - (end - size)[owner]
    powers = np.cumprod(np.r_[np.uint64(1), np.full(size.max(initial=1) - 1, MIX, np.uint64)])
    hashes, owners = [np.add.reduceat(codes * powers[place], end - size) + np.uint64(1)], [np.arange(len(words), dtype=np.int32)]
    rolling = codes
    for n in range(2, GRAMS[-1] + 1):
        rolling = rolling[:-1] * MIX + codes[n - 1 :]
        if n in GRAMS:
            inside = np.arange(len(rolling)) + n <= end[owner[: len(rolling)]]
            hashes.append(rolling[inside] * np.uint64(2 * n + 1))
            owners.append(owner[: len(rolling)][inside])
    mixed = np.concatenate(hashes) * MIX
    return ((mixed >> np.uint64(40)) % np.uint64(BUCKETS)).astype(np.int32), np.concatenate(owners)


def bare(word: str) -> str:
    """A word without punctuation around it; a word of punctuation alone stays."""
    return word.strip(string.punctuation) or word


def words_of(text: str) -> list[str]:
    return text.lower().split()


@dataclasses.dataclass
class Model:
    """``weights`` is each n-gram's vector times the difference of the two softmax rows."""

    weights: np.ndarray
    bias: float

    def values(self, words: list[str]) -> list[float]:
        """The mean over a word's n-grams, for each word."""
        buckets, owner = subwords(words)
        sums = np.bincount(owner, self.weights[buckets], len(words))
        return (sums / np.bincount(owner, minlength=len(words))).tolist()

    def scores(self, docs: Iterable[str]) -> Iterator[float]:
        """Probability of label 1 of each text.  A text without words has the bias alone."""
        memo: dict[str, float] = {}
        for some in in_chunks(docs, CHUNK):
            split = [words_of(x) for x in some]
            if len(memo) > MEMO:
                memo.clear()
            missing = list(set().union(*split).difference(memo))
            for part in in_chunks(missing, CHUNK):
                memo.update(zip(part, self.values([bare(w) for w in part]), strict=True))
            for words in split:
                mean = sum(map(memo.__getitem__, words)) / len(words) if words else 0.0
                yield float(1 / (1 + np.exp(-(self.bias + mean))))


def _gather(ids: np.ndarray, starts: np.ndarray, values: np.ndarray, weights=None) -> np.ndarray:
    rows = values[ids]
    if weights is not None:
        rows = rows * weights[:, None]
    return np.add.reduceat(rows, starts, axis=0)


@dataclasses.dataclass
class _Batch:
    """Index arrays of some documents: document to words, word to n-grams, and both ways back."""

    words: np.ndarray
    doc_starts: np.ndarray
    counts: np.ndarray
    turned_docs: np.ndarray
    turned_starts: np.ndarray
    turned_counts: np.ndarray
    gram: np.ndarray
    word_starts: np.ndarray
    back: np.ndarray
    back_starts: np.ndarray
    used: np.ndarray
    inverse: np.ndarray
    target: np.ndarray

    @classmethod
    def of(cls, members, row_at, words, counts, gram_at, gram, inverse, labels) -> "_Batch":
        size = row_at[members + 1] - row_at[members]
        rows = _ranges(row_at[members], size)
        mine, word = np.unique(words[rows], return_inverse=True)
        turn = np.argsort(word, kind="stable")
        length = gram_at[mine + 1] - gram_at[mine]
        used, local = np.unique(gram[_ranges(gram_at[mine], length)], return_inverse=True)
        back = np.argsort(local, kind="stable")
        owner = np.repeat(np.arange(len(mine), dtype=np.int32), length)
        return cls(
            word.astype(np.int32),
            np.r_[0, np.cumsum(size)[:-1]],
            counts[rows],
            np.repeat(np.arange(len(members), dtype=np.int32), size)[turn],
            np.flatnonzero(np.r_[True, np.diff(word[turn]) != 0]),
            counts[rows][turn],
            local.astype(np.int32),
            np.r_[0, np.cumsum(length)[:-1]],
            owner[back],
            np.flatnonzero(np.r_[True, np.diff(local[back]) != 0]),
            used,
            inverse[mine],
            labels[members].astype(int),
        )

    def gradients(self, state: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        u = _gather(self.gram, self.word_starts, state["v"][self.used]) * self.inverse
        x = _gather(self.words, self.doc_starts, u, self.counts) * SCALE
        z = x @ state["w"] + state["b"]
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        slip = p.astype(np.float32)
        slip[np.arange(len(slip)), self.target] -= 1
        slip /= len(slip)
        dx = slip @ state["w"].T * SCALE
        du = _gather(self.turned_docs, self.turned_starts, dx, self.turned_counts) * self.inverse
        v = DECAY * state["v"]
        v[self.used] += _gather(self.back, self.back_starts, du)
        return {"v": v, "w": x.T @ slip, "b": slip.sum(axis=0)}


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The whole numbers of all ranges, one after the other."""
    return np.repeat(starts - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum())


def train(rows: list[tuple[str, int]], epochs: int = EPOCHS, seed: int = 7) -> Model:
    """Fit to (text, label) rows.

    A document is the mean of its words' vectors, a word the mean of its n-grams' vectors.
    Vectors and softmax are trained together by Adam.  Words of few documents are left out of
    the fit (not of scoring).  Texts without words teach the bias alone.  Without
    rows, or with one label only, the score is that of the label's smoothed share.
    """
    labels = np.array([y for _, y in rows], np.float64)
    share = (labels.sum() + 0.5) / (len(labels) + 1.0)
    flat = Model(np.zeros(BUCKETS, np.float32), float(np.log(share / (1 - share))))
    if len(labels) == 0 or labels.min() == labels.max():
        return flat
    seen: dict[str, int] = {}
    docs, words, counts = array("i"), array("i"), array("f")
    for d, (text, _) in enumerate(rows):
        bag = Counter(map(bare, words_of(text)))
        total = bag.total()
        for w, n in bag.items():
            docs.append(d)
            words.append(seen.setdefault(w, len(seen)))
            counts.append(n / total)
    docs, words, counts = np.array(docs), np.array(words), np.array(counts)
    often = np.bincount(words, minlength=len(seen)) >= MIN_DOCUMENTS
    if not often.any():
        return flat
    keep = often[words]
    docs, words, counts = docs[keep], words[keep], counts[keep]
    words = (np.cumsum(often, dtype=np.int32) - 1)[words]
    gram, owner = subwords([w for w, i in seen.items() if often[i]])
    del seen
    gram = gram[np.argsort(owner, kind="stable")]
    size = np.bincount(owner)
    del owner
    gram_at = np.r_[0, np.cumsum(size)]
    inverse = (1.0 / size).astype(np.float32)[:, None]
    used, gram = np.unique(gram, return_inverse=True)
    gram = gram.astype(np.int32)
    rng = np.random.default_rng(seed)
    present, first_row = np.unique(docs, return_index=True)
    row_at = np.r_[first_row, len(docs)]
    order = rng.permutation(len(present))
    batches = [
        _Batch.of(order[i : i + BATCH], row_at, words, counts, gram_at, gram, inverse, labels[present])
        for i in range(0, len(order), BATCH)
    ]
    state = {
        "v": rng.normal(0, 0.1, (len(used), DIM)).astype(np.float32),
        "w": rng.normal(0, 0.5, (DIM, 2)).astype(np.float32),
        "b": np.array([0.0, flat.bias], np.float32),
    }
    first = {k: np.zeros_like(x) for k, x in state.items()}
    second = {k: np.zeros_like(x) for k, x in state.items()}
    steps, step = epochs * len(batches), 0
    for _ in range(epochs):
        for i in rng.permutation(len(batches)):
            step += 1
            rate = RATE * (1 - (step - 1) / steps)
            for k, g in batches[i].gradients(state).items():
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.01 * (g * g - second[k])
                state[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    weights = np.zeros(BUCKETS, np.float32)
    weights[used] = SCALE * (state["v"] @ (state["w"][:, 1] - state["w"][:, 0]))
    return Model(weights, float(state["b"][1] - state["b"][0]))


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAINING_ROWS) -> list[tuple[str, int]]:
    """At most ``max_rows`` labelled (text, label) rows, of the smallest id hashes.

    Rows with a null label or id teach nothing; an id labelled twice counts once, with its largest label.
    """
    wanted = (
        labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.max(F.col("toxic").cast("int")).alias("_toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_rows)
    )
    found = texts(docs).join(F.broadcast(wanted), "doc_id").select("doc_id", "text", "_toxic")
    rows = found.orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(max_rows).toLocalIterator()
    return [(r.text, r._toxic) for r in rows]


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAINING_ROWS) -> Model:
    return train(training_rows(docs, labels, max_rows))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, predicted) for every whole text; null texts count as empty.  No shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            found = shared.value.scores(x.decode("utf-8", "replace") for x in encoded(batch.column("text")))
            found = np.fromiter(found, np.float64, batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(found), pa.array((found >= 0.5).astype(np.int32))],
                names=["doc_id", "score", "predicted"],
            )

    return texts(docs).mapInArrow(run, "doc_id long, score double, predicted int")


def held_out(doc_id: str = "doc_id"):
    return fold(doc_id) == 0
