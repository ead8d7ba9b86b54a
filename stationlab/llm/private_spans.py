"""Personal data in whole texts: fixed patterns, and a linear-chain conditional random field that adds spans.

The field reads the shapes of words (classes of characters with runs collapsed, lengths of digit runs) of a word
and its two neighbours on either side.  It is trained in numpy from a small labelled table: written
examples of forms that the patterns miss, with look-alikes that are not personal, and a bounded
sample of word windows of the corpus labelled by the patterns.  Decoding is Viterbi over many lines
at once.  The patterns' spans always stay; the field adds spans that overlap none of them.
"""

import hashlib
import itertools
import random
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stationlab.llm.common import in_chunks, texts

KINDS = ("email", "ip", "card", "phone")
TAGS = 1 + 2 * len(KINDS)
"""0 is outside; 1 + 2k opens a span of kind k, 2 + 2k goes on with it."""
REACH = 2
SAMPLE_DOCUMENTS = 2000
"""Documents, of the smallest id hashes, whose windows the labelled table may take."""
SAMPLE_WINDOWS = 3000
WINDOW_WORDS, WINDOW_CHARS = 24, 600
SPANS_PER_DOCUMENT = 4
CHUNK_CHARS = 2 << 20
"""Text decoded together; a longer text is a chunk of its own."""
PIECE_WORDS, HALO_WORDS = 256, 16
"""A line of more words is decoded in pieces, each with so many words of its neighbours as context."""
ROUNDS, BATCH, RATE, DECAY = 10, 128, 0.05, 1e-3

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


# --- patterns ---------------------------------------------------------------------------------


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """From each ``@`` back over what may stand before it: a run is read once, however long."""
    low, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > low and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            low = found.end()
            yield start, low
        at = text.find("@", max(low, at + 1))


def luhn(digits: str) -> bool:
    odd = [int(d) for d in digits[-1::-2]]
    even = [int(d) for d in digits[-2::-2]]
    return (sum(odd) + sum(2 * d - 9 * (d > 4) for d in even)) % 10 == 0


def patterns(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all pattern matches, by kind, then start."""
    found = [("email", *x) for x in _emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return found
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in m[0].split("."))):
            found.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if 16 <= m.end() - m.start() <= 37:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(map(m[0].count, "0123456789")) <= 15:
                found.append(("phone", *m.span()))
    return found


# --- words and features -----------------------------------------------------------------------

_SPACE = np.zeros(128, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_OTHER, _LOWER, _UPPER, _NUMBER = 0, 1, 2, 3
_MARKS = "@.+-():/_%[]"
_CLASS = np.zeros(129, np.int64)
_CLASS[[ord(c) for c in "abcdefghijklmnopqrstuvwxyz"]] = _LOWER
_CLASS[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]] = _UPPER
_CLASS[[ord(c) for c in "0123456789"]] = _NUMBER
_CLASS[[ord(c) for c in _MARKS]] = np.arange(4, 4 + len(_MARKS))
_CLASS[128] = _LOWER  # all beyond ASCII
_INNER = np.isin(_CLASS, [_LOWER, _UPPER, _NUMBER])
_FIRST, _LAST = _INNER.copy(), _INNER.copy()
_FIRST[[ord(c) for c in "+(["]] = True
_LAST[[ord(c) for c in ")]"]] = True
_DIGITS = np.array([0, 1, 2, 3, 4, 5, 5, 5, 6, 7, 8, 8, 8, 8, 8, 8, 9, 9, 9, 9] + [10] * 45)
_SIZES = (1 << 12, 1 << 10, 1 << 4, 1 << 8, 1 << 4, 1 << 12)
"""Buckets of the features: shape, first and last run, digits, marks, length, the word itself."""
_OFFSETS = np.cumsum((0, *_SIZES))
_PAD = int(_OFFSETS[-1])
_MIX = np.uint64(0x9E3779B97F4A7C15)
with np.errstate(over="ignore"):
    _POWERS = np.cumprod(np.full(64, np.uint64(0x100000001B3)))


def _bucket(x: np.ndarray, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((x * _MIX) >> np.uint64(40)).astype(np.int64) % size


def words(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all words between ASCII white space: start and end without outer punctuation, line, features (a row a word).

    A word that is all punctuation has an empty extent.  Lines end at line feeds.
    """
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    code = np.minimum(points, 128).astype(np.int64)
    inside = np.append(code, 0x20)
    inside = ~_SPACE[np.minimum(inside, 127)] | (inside == 128)
    edge = np.diff(inside.astype(np.int8), prepend=0)
    begin, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(begin):
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros((0, len(_SIZES)), np.int64)
    line = np.searchsorted(np.flatnonzero(points == 10), begin)
    place = np.arange(len(code))
    reach = np.maximum.reduceat(np.where(_LAST[code], place, -1), begin) + 1
    low = np.minimum.reduceat(np.where(_FIRST[code], place, len(code)), begin)
    # reduceat also covers the white space after a word; no class there is first or last.
    empty = (reach <= low) | (low >= stop)
    low, high = np.where(empty, begin, low), np.where(empty, begin, reach)
    size = high - low
    word = np.repeat(np.arange(len(begin)), size)
    at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(low, size)
    kind = _CLASS[code[at]]
    features = np.zeros((len(begin), len(_SIZES)), np.int64)
    if len(at):
        new = np.append(True, (kind[1:] != kind[:-1]) | (word[1:] != word[:-1]))
        start = np.flatnonzero(new)
        length = np.diff(np.append(start, len(at)))
        run = kind[start] * 8 + np.where(kind[start] == _NUMBER, np.minimum(length, 7), 0)
        owner = word[start]
        first = np.searchsorted(owner, np.arange(len(begin)))
        last = np.searchsorted(owner, np.arange(len(begin)), "right") - 1
        order = np.arange(len(start)) - first[owner]
        have = np.flatnonzero(~empty)
        with np.errstate(over="ignore"):
            shape = np.add.reduceat((run + 1).astype(np.uint64) * _POWERS[np.minimum(order, 63)], first[have])
            letter = (code[at] | np.where(kind == _UPPER, 0x20, 0)).astype(np.uint64)
            ordinal = np.arange(len(at)) - (np.cumsum(size) - size)[word]
            spelt = np.add.reduceat((letter + np.uint64(1)) * _POWERS[np.minimum(ordinal, 63)], (np.cumsum(size) - size)[have])
        features[have, 0] = _bucket(shape, _SIZES[0])
        features[have, 1] = _bucket((run[first[have]] * 512 + run[last[have]] + 1).astype(np.uint64), _SIZES[1])
        digits = np.add.reduceat((kind == _NUMBER).astype(np.int64), (np.cumsum(size) - size)[have])
        features[have, 2] = 1 + _DIGITS[np.minimum(digits, 64)]
        for bit, mark in enumerate("@.+-():["):
            own = (kind == _CLASS[ord(mark)]).astype(np.int64)
            features[have, 3] |= np.minimum(np.add.reduceat(own, (np.cumsum(size) - size)[have]), 1) << bit
        features[have, 4] = 1 + np.minimum(size[have], 14)
        features[have, 5] = _bucket(spelt, _SIZES[5])
    return low, high, line, features + _OFFSETS[:-1]


def _around(features: np.ndarray, chain: np.ndarray) -> np.ndarray:
    """Features of each word and its neighbours in the same chain: (words, places, features); beyond it, padding."""
    n = len(features)
    out = np.full((n, 2 * REACH + 1, features.shape[1]), _PAD, np.int64)
    for k, offset in enumerate(range(-REACH, REACH + 1)):
        a, b = max(0, -offset), max(0, min(n, n - offset))
        if b > a:
            same = chain[a:b] == chain[a + offset : b + offset]
            out[a:b, k][same] = features[a + offset : b + offset][same]
    return out


# --- the field --------------------------------------------------------------------------------


def _allowed() -> np.ndarray:
    """Which tag may follow which: a span goes on only after its own kind."""
    ok = np.ones((TAGS + 1, TAGS), bool)  # the last row is the start of a chain
    for k in range(len(KINDS)):
        ok[:, 2 + 2 * k] = False
        ok[[1 + 2 * k, 2 + 2 * k], 2 + 2 * k] = True
    return ok


class Field:
    """Weights of a linear-chain conditional random field: of (place, feature, tag) and of (tag, tag)."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray):
        self.weights = weights.astype(np.float32)
        self.moves = np.where(_allowed(), moves, -1e4).astype(np.float32)

    def scores(self, features: np.ndarray, chain: np.ndarray) -> np.ndarray:
        """Per word and tag, the sum of the weights of its features and its neighbours'."""
        n = len(features)
        out = np.zeros((n, TAGS), np.float32)
        for k, offset in enumerate(range(-REACH, REACH + 1)):
            beyond = features.shape[1] * self.weights[k][_PAD]
            out += beyond
            a, b = max(0, -offset), max(0, min(n, n - offset))
            if b <= a:
                continue
            own = np.zeros((b - a, TAGS), np.float32) - beyond
            for f in range(features.shape[1]):
                own += self.weights[k][features[a + offset : b + offset, f]]
            out[a:b] += own * (chain[a:b] == chain[a + offset : b + offset])[:, None]
        return out

    def decode(self, score: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The best tags of all words; chains are runs of ``size`` words from ``start``, stepped through together."""
        tags = np.zeros(len(score), np.int8)
        order = np.argsort(-size, kind="stable")
        start, size = start[order], size[order]
        longest = int(size.max(initial=0))
        on = np.searchsorted(-size, -np.arange(longest), "left")  # chains longer than t
        back = []
        best = score[start] + self.moves[TAGS] if longest else np.zeros((0, TAGS), np.float32)
        for t in range(1, longest):
            live = on[t]
            paths = best[:live, :, None] + self.moves[:TAGS]
            came = paths.argmax(1)
            back.append(came.astype(np.int8))
            best[:live] = np.take_along_axis(paths, came[:, None], 1)[:, 0] + score[start[:live] + t]
        state = best.argmax(1) if longest else np.zeros(0, np.int64)
        for t in range(longest - 1, -1, -1):
            live = on[t]
            tags[start[:live] + t] = state[:live]
            if t:
                state[:live] = np.take_along_axis(back[t - 1], state[:live, None], 1)[:, 0]
        return tags


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


def likelihood(weights, moves, around, tags, start, size) -> tuple[float, np.ndarray, np.ndarray]:
    """Log-likelihood of the tags of all chains, and its gradient in the weights (flat) and the moves.

    Forward and backward run over all chains at once, padded to the longest.
    """
    n, longest = len(start), int(size.max())
    score = weights.reshape(2 * REACH + 1, -1, TAGS)
    score = sum(score[k][around[:, k]].sum(1) for k in range(2 * REACH + 1))
    moves = np.where(_allowed(), moves, -1e4)
    at = np.minimum(start[:, None] + np.arange(longest), len(score) - 1)
    on = np.arange(longest) < size[:, None]
    padded = score[at]
    forward, backward = np.zeros((n, longest, TAGS)), np.zeros((n, longest, TAGS))
    forward[:, 0] = padded[:, 0] + moves[TAGS]
    for t in range(1, longest):
        ahead = _log_sum(forward[:, t - 1, :, None] + moves[:TAGS], 1) + padded[:, t]
        forward[:, t] = np.where(on[:, t, None], ahead, forward[:, t - 1])
    for t in range(longest - 2, -1, -1):
        ahead = _log_sum(moves[:TAGS] + (padded[:, t + 1] + backward[:, t + 1])[:, None, :], 2)
        backward[:, t] = np.where(on[:, t + 1, None], ahead, 0)
    total = _log_sum(forward[:, -1], 1)
    share = np.exp(forward + backward - total[:, None, None])[on]
    words_at = at[on]
    truth = np.zeros_like(share)
    truth[np.arange(len(words_at)), tags[words_at]] = 1
    left = truth - share
    slope = np.zeros_like(weights.reshape(-1, TAGS))
    flat = (around[words_at] + np.arange(2 * REACH + 1)[None, :, None] * (_PAD + 1)).reshape(len(words_at), -1)
    repeated = np.repeat(np.arange(len(words_at)), flat.shape[1])
    for tag in range(TAGS):
        slope[:, tag] = np.bincount(flat.ravel(), left[repeated, tag], len(slope))
    move = np.zeros_like(moves)
    move[TAGS] = (np.eye(TAGS)[tags[start]] - np.exp(forward[:, 0] + backward[:, 0] - total[:, None])).sum(0)
    gained = np.take_along_axis(padded, tags[at][:, :, None], 2)[:, :, 0]
    gained = np.where(on, gained, 0).sum() + moves[TAGS, tags[start]].sum()
    for t in range(1, longest):
        live = on[:, t]
        pair = forward[live, t - 1, :, None] + moves[:TAGS] + (padded[live, t] + backward[live, t])[:, None, :]
        move[:TAGS] -= np.exp(pair - total[live, None, None]).sum(0)
        a, b = tags[at[live, t - 1]], tags[at[live, t]]
        np.add.at(move, (a, b), 1)
        gained += moves[a, b].sum()
    return float(gained - total.sum()), slope.reshape(weights.shape), move * _allowed()


def tagged(low: np.ndarray, high: np.ndarray, spans: Iterable[tuple[str, int, int]]) -> np.ndarray:
    """The tags of words under spans: the first word that a span touches opens it."""
    tags = np.zeros(len(low), np.int64)
    for kind, start, end in spans:
        under = np.flatnonzero((low < end) & (high > start))
        if len(under) and not tags[under].any():
            tags[under] = 2 + 2 * KINDS.index(kind)
            tags[under[0]] -= 1
    return tags


def train(examples: list[tuple[str, list[tuple[str, int, int]]]], rounds: int = ROUNDS) -> Field:
    """Fit to (text, spans) rows by Adam on batches in drawn order, with weight decay.  No rows give a field that adds nothing."""
    rows = []
    for text, spans in examples:
        low, high, _, found = words(text)
        if len(low):
            rows.append((_around(found, np.zeros(len(low))), tagged(low, high, spans)))
    weights = np.zeros((2 * REACH + 1, _PAD + 1, TAGS))
    moves = np.zeros((TAGS + 1, TAGS))
    if not rows:
        moves[:, 1:] = -1e4
        return Field(weights, moves)
    state = [np.zeros_like(x) for x in (weights, weights, moves, moves)]
    draw = np.random.default_rng(11)
    batches = -(-len(rows) // BATCH)
    t, last = 0, rounds * batches
    for _ in range(rounds):
        order = draw.permutation(len(rows))
        for part in np.array_split(order, batches):
            some = sorted((rows[i] for i in part), key=lambda r: len(r[1]))
            size = np.array([len(r[1]) for r in some])
            around, tags = np.concatenate([r[0] for r in some]), np.concatenate([r[1] for r in some])
            _, *slopes = likelihood(weights, moves, around, tags, np.cumsum(size) - size, size)
            t += 1
            for x, slope, mean, square in zip((weights, moves), slopes, state[::2], state[1::2], strict=True):
                slope -= DECAY * len(part) * x
                mean += 0.1 * (slope - mean)
                square += 0.01 * (slope**2 - square)
                x += RATE * (1 - t / (last + 1)) * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.99**t)) + 1e-8)
    return Field(weights, moves)


# --- the labelled table -----------------------------------------------------------------------

# Forms that the patterns miss ({d} one digit), by kind, and look-alikes that are not personal.
FORMS = {
    "phone": ("({ddd}) {ddd}-{dddd}", "{ddd}-{ddd}-{dddd}", "{ddd}.{ddd}.{dddd}", "00{dd} {ddd} {ddd} {ddd}", "0{d} {dd} {dd} {dd} {dd}"),
    "email": ("{a}.{a} at {a} dot com", "{a} (at) {a} (dot) org", "{a}[at]{a}[dot]net", "{a}(at){a}.org"),
    "ip": ("{ddd}[.]{dd}[.]{dd}[.]{ddd}", "{dd}[.]{d}[.]{ddd}[.]{dd}", "{dddd}:db8:{dddd}::{dd}:{dddd}"),
    "card": ("{dddd}.{dddd}.{dddd}.{dddd}", "{dddd}/{dddd}/{dddd}/{dddd}", "{dddd}_{dddd}_{dddd}_{dddd}"),
}
PLAIN = (
    "{dd}.{dd}.{dddd}", "{dddd}-{dd}-{dd}", "{dd}:{dd}:{dd}", "{d}.{d}.{d}", "{d},{ddd}.{dd}", "{dddd}-{dddd}", "{dd}%", "({dddd})",
    "{ddd}", "{dddddd}", "{dddddddddddd}", "{dddddddddddddddd}", "{d}.{dd}", "v{d}.{dd}.{d}", "{dd}/{dd}/{dddd}", "#{dddd}", "{a}{dd}", "${dd}.{dd}",
    "{d}-{d}", "{ddd}-{ddd}", "{a}@{a}", "@{a}", "at {a}", "dot {a}", "{a}.{a}", "{a}-{a}", "({a})", "{a}:{a}", "{dd}:{dd}", "{d}a{dd}f{ddd}c{d}e",
)
LINES = 12
"""Written examples of each form."""


def written(seed: int = 11) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Examples made from the forms by rule: a form with drawn digits and letters between drawn words."""
    draw = random.Random(seed)

    def word():
        return "".join(draw.choice("abcdefghijklmnoprstuvwyé") for _ in range(draw.randrange(2, 10)))

    def fill(kind, form):
        part = lambda m: word() if m[1] == "a" else str(draw.randrange(2)) + "".join(str(draw.randrange(10)) for _ in m[1][1:])
        made = re.sub(r"\{(a|d+)\}", part, form)
        if kind == "card":  # the last digit makes the check sum right
            made = next(x for x in (made[:-1] + str(d) for d in range(10)) if luhn(re.sub(r"[^0-9]", "", x)))
        return made

    rows = []
    for kind, forms in [*FORMS.items(), (None, PLAIN)]:
        for form, _ in itertools.product(forms, range(LINES)):
            before = "".join(word() + draw.choice(["", "", ",", "."]) + " " for _ in range(draw.randrange(0, 7)))
            middle = fill(kind, form)
            after = draw.choice(["", ".", ",", "###", "!!"]) + "".join(" " + word() for _ in range(draw.randrange(0, 7)))
            spans = [(kind, len(before), len(before) + len(middle))] if kind else []
            rows.append((before + middle + after, spans))
    return rows


def _windows(text: str, salt: str) -> Iterator[tuple[str, list[tuple[str, int, int]]]]:
    """Of one document: windows around its first spans, and one at a drawn place; spans relative to the window."""
    low, high, line, _ = words(text)
    if not len(low):
        return
    spans = patterns(text)
    middles = [int(np.searchsorted(high, s, "right")) for _, s, _ in spans[:SPANS_PER_DOCUMENT]]
    middles.append(int(hashlib.md5(salt.encode() + text[:64].encode("utf-8", "replace")).hexdigest(), 16) % len(low))
    for middle in middles:
        middle = min(middle, len(low) - 1)
        same = np.flatnonzero(line[max(0, middle - 200) : middle + 200] == line[middle]) + max(0, middle - 200)
        inside = same[np.abs(same - middle) <= WINDOW_WORDS // 2]
        a, b = int(low[inside[0]]), int(high[inside[-1]])
        if 0 < b - a <= WINDOW_CHARS:
            yield text[a:b], [(k, max(s, a) - a, min(e, b) - a) for k, s, e in spans if s < b and e > a]


_LABELLED = "text string, kinds array<string>, starts array<int>, ends array<int>"


def labelled(docs: DataFrame) -> DataFrame:
    """The labelled table: written examples, and windows of a sample of ``docs`` labelled by the patterns.

    The sample is ``SAMPLE_WINDOWS`` windows of ``WINDOW_CHARS`` characters at most, from the ``SAMPLE_DOCUMENTS`` documents of the
    smallest id hashes: ids are chosen before texts move.
    """
    spark = docs.sparkSession
    ids = docs.select("doc_id").filter("doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCUMENTS).distinct()

    def run(batches):
        for batch in batches:
            rows: list = [[], [], [], []]
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for window, spans in _windows(text, str(doc)):
                    for column, value in zip(rows, (window, *([s[k] for s in spans] for k in range(3))), strict=True):
                        column.append(value)
            types = [pa.string(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int32())]
            names = ["text", "kinds", "starts", "ends"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types, strict=True)], names=names)

    sample = texts(docs).join(F.broadcast(ids), "doc_id", "left_semi").mapInArrow(run, _LABELLED)
    few = sample.orderBy(F.size("kinds").desc(), F.xxhash64("text"), "text").limit(SAMPLE_WINDOWS)
    own = [(t, [s[0] for s in spans], [s[1] for s in spans], [s[2] for s in spans]) for t, spans in written()]
    return spark.createDataFrame(own, _LABELLED).unionByName(few)


def fit(table: DataFrame) -> Field:
    """Train on a labelled table (text, kinds, starts, ends) small enough for the driver, in a fixed order."""
    rows = sorted((r.text, tuple(zip(r.kinds, r.starts, r.ends, strict=True))) for r in table.collect())
    return train([(text, list(spans)) for text, spans in rows])


# --- spans ------------------------------------------------------------------------------------


def plausible(kind: str, text: str) -> bool:
    """What an added span must have at least: the digits and marks its kind needs, and their check where there is one."""
    digits = sum(c in "0123456789" for c in text)
    if kind == "email":
        return "@" in text or re.search(r"\bat\b.*\bdot\b|[\[(]at[\])]", text, re.I) is not None
    if kind == "ip":
        parts = re.findall(r"[0-9]+", text)
        return len(re.findall(r"[.:]", text)) >= 3 and (":" in text or all(len(p) <= 3 and int(p) <= 255 for p in parts))
    if kind == "phone":
        return 7 <= digits <= 15
    return 13 <= digits <= 19 and luhn(re.sub(r"[^0-9]", "", text))


def added(some: list[str], field: Field, base: list[list[tuple[str, int, int]]]) -> list[list[tuple[str, int, int]]]:
    """The spans that the field finds in texts, without those that overlap a pattern's or are not plausible."""
    joined = "\n".join(some)
    low, high, line, features = words(joined)
    out: list[list[tuple[str, int, int]]] = [[] for _ in some]
    if not len(low):
        return out
    score = field.scores(features, line)
    first = np.flatnonzero(np.append(True, line[1:] != line[:-1]))
    size = np.diff(np.append(first, len(line)))
    pieces = np.maximum(1, -(-size // PIECE_WORDS))
    begin = np.repeat(first, pieces) + PIECE_WORDS * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    chain_end = np.repeat(first + size, pieces)
    end = np.minimum(begin + PIECE_WORDS, chain_end)
    before = np.maximum(begin - HALO_WORDS, np.repeat(first, pieces))
    length = np.minimum(end + HALO_WORDS, chain_end) - before
    # Each piece is decoded with its context on a copy; only its own words keep their tags.
    place = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length) + np.repeat(before, length)
    own = (place >= np.repeat(begin, length)) & (place < np.repeat(end, length))
    tags = np.zeros(len(low), np.int64)
    tags[place[own]] = field.decode(score[place], np.cumsum(length) - length, length)[own]
    at = np.flatnonzero(tags)
    if not len(at):
        return out
    goes_on = (tags[at] % 2 == 0) & np.append(False, (np.diff(at) == 1) & (line[at[1:]] == line[at[:-1]]) & ((tags[at[1:]] + 1) // 2 == (tags[at[:-1]] + 1) // 2))
    heads = at[~goes_on]
    tails = at[np.append(np.flatnonzero(~goes_on)[1:] - 1, len(at) - 1)]
    starts = np.cumsum([0, *(len(t) + 1 for t in some)])
    for head, tail in zip(heads.tolist(), tails.tolist(), strict=True):
        a, b = int(low[head]), int(high[tail])
        doc = int(np.searchsorted(starts, a, "right")) - 1
        kind = KINDS[(int(tags[head]) - 1) // 2]
        a, b = a - int(starts[doc]), b - int(starts[doc])
        if b > a and plausible(kind, some[doc][a:b]) and not any(s < b and e > a for _, s, e in base[doc]):
            out[doc].append((kind, a, b))
    return out


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1])))


_ROWS = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def spans(docs: DataFrame, field: Field) -> DataFrame:
    """Per document: numbers of pattern matches by kind, the digest of their list, all spans, and how many the field added.

    Spans are ``kind:start:end`` by kind (email, ip, card, phone), then start; code points, end exclusive.  A null or
    empty text has none.  Rows of one id, or without, are documents of their own; no rows give none; other columns are not
    read.  Lines are chains; the words of a longer line than ``PIECE_WORDS`` are decoded in pieces with context.
    """
    spark: SparkSession = docs.sparkSession
    shared = spark.sparkContext.broadcast(field)

    def run(batches):
        model = shared.value
        for batch in batches:
            ids, whole, at = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), 0
            for some in in_chunks(whole, CHUNK_CHARS):
                base = [patterns(t) for t in some]
                more = added(some, model, base)
                columns: list = [ids[at : at + len(some)]]
                columns += [[sum(s[0] == kind for s in b) for b in base] for kind in KINDS]
                columns.append([hashlib.sha256(_joined(b).encode()).hexdigest() for b in base])
                columns += [[_joined(b + m) for b, m in zip(base, more, strict=True)], [len(m) for m in more]]
                at += len(some)
                types = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.int64()]
                names = [x.split(" ")[0] for x in _ROWS.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return texts(docs).mapInArrow(run, _ROWS)
