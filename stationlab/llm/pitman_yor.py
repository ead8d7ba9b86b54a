"""Language-model scores from a hierarchical Pitman-Yor model with sampled seating.

Every word before a token is a context with a restaurant of its own; a text's first token follows
the end of a text.  Parent of a context is the restaurant of its class (words of one ending; ends
of texts are a class), parent of the classes the root, whose base is uniform over the known words
and one unknown.  Tables are sampled by Gibbs sweeps: each sweep seats all customers of every
dish anew, given the tables of all others after the sweep before.

Work is laid out by blocks of documents and buckets of words.  Words are known by 64-bit hashes;
a word's bucket gives it a number that tells bucket and class.  A block asks a bucket for its
distinct (word, context) pairs, with their training counts, once; all of a word's pairs are
in one bucket, so that parents and dishes meet without a shuffle.  A context's tables are spread
over the buckets of the words that follow it: each sweep the buckets send what they have of it
to the bucket of the context as a word, which adds up and answers those with a dish to seat.  Only
pairs with more than one customer can change.  The driver sees one number per class.
"""

import dataclasses
import math
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationlab.llm.common import cut, encoded, texts

BLOCK_BYTES = 8 << 20
BUCKET_BYTES = 16 << 20
"""Text for which there is one more bucket."""
ENDINGS = 512
CLASSES = ENDINGS + 1
"""The last: the end of a text."""
SWEEPS, BURN_IN = 3, 1
STRENGTH = 1.0
SEED = 5
END = xxhash.xxh64_intdigest(b"\n")
BUCKET_SHIFT = 40
"""A word's number: its bucket, then rank * CLASSES + class in 40 bits.  Rank 0: never seen in training, bucket 0."""
NAME = (1 << BUCKET_SHIFT) - 1


def packed(x: np.ndarray) -> bytes:
    """Compressed, with the first bytes of all items before the second ones."""
    planes = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T
    return zstandard.ZstdCompressor(level=3).compress(planes.tobytes())


def unpacked(x: bytes, kind: str) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(x), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).reshape(-1)


def bundle(*some: tuple[np.ndarray, str]) -> list[bytes]:
    return [packed(np.asarray(x).astype(kind)) for x, kind in some]


def unbundled(data: list[bytes], kinds: str) -> list[np.ndarray]:
    return [unpacked(x, kind) for x, kind in zip(data, kinds.split(), strict=True)]


def joined(parts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def laid(df: DataFrame, n: int, key: str) -> DataFrame:
    """``df`` cut, all rows of a key in one of ``n`` partitions.

    Later steps by that key see this and don't shuffle it again, which they would not if the plan were adaptive.
    """
    conf, name = df.sparkSession.conf, "spark.sql.adaptive.enabled"
    was = conf.get(name)
    conf.set(name, "false")
    try:
        return cut(df.repartition(n, key))
    finally:
        conf.set(name, was)


_BLOCKS = "block long, doc_ids binary, nulls binary, train binary, lengths binary, words binary, endings binary, tokens binary"


def _blocks(docs: DataFrame, folds: int, out_fold: int, block_bytes: int, n: int) -> DataFrame:
    """Documents as blocks of packed arrays: distinct words by hash, frequent ones first, and the tokens as places among them."""

    def run(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            lengths = batch.column("text").cast(pa.binary())
            reached = np.cumsum(np.array(pc.fill_null(pc.binary_length(lengths), 0), np.int64) + 64)
            low = 0
            while low < len(batch):
                base = int(reached[low - 1]) if low else 0
                high = min(len(batch), int(np.searchsorted(reached, base + block_bytes)) + 1)
                some = batch.slice(low, high - low)
                chunk = list(zip(some.column("doc_id").to_pylist(), encoded(some.column("text")), strict=True))
                low = high
                seen: dict[bytes, int] = {b"\n": 0}
                tokens, lengths = [], []
                for _, text in chunk:
                    words = text.lower().split()
                    for w in set(words).difference(seen):
                        seen[w] = len(seen)
                    tokens.append(np.fromiter(map(seen.__getitem__, words), np.uint32, len(words)))
                    tokens.append(np.zeros(1, np.uint32))
                    lengths.append(len(words) + 1)
                ids = [d for d, _ in chunk]
                crc = np.array([zlib.crc32(b"" if d is None else str(d).encode()) % folds for d in ids])
                tokens = np.concatenate(tokens)
                hashes = np.array([xxhash.xxh64_intdigest(w) for w in seen], np.uint64)
                endings = np.array([zlib.crc32(w[-2:]) % ENDINGS for w in seen], np.uint16)
                endings[0] = ENDINGS
                order = np.lexsort((hashes, -np.bincount(tokens, minlength=len(seen))))
                place = np.empty(len(order), np.uint32)
                place[order] = np.arange(len(order), dtype=np.uint32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x]) for x in (
                        number,
                        packed(np.array([d or 0 for d in ids], np.int64)),
                        packed(np.array([d is None for d in ids], np.uint8)),
                        packed((crc != out_fold).astype(np.uint8)),
                        packed(np.array(lengths, np.int64)),
                        packed(hashes[order]),
                        packed(endings[order]),
                        packed(place[tokens]),
                    )],
                    names=[x.split()[0] for x in _BLOCKS.split(", ")],
                )
                number += 1

    return laid(texts(docs).mapInArrow(run, _BLOCKS), n, "block")


_ROWS = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("data", pa.list_(pa.binary()))])
_ROW = "bucket int, block long, data array<binary>"


def _rows(found: list[tuple]) -> pa.Table:
    return pa.Table.from_pylist([dict(zip(_ROWS.names, x, strict=True)) for x in found], schema=_ROWS)


def _by_bucket(words: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of a block's words by (bucket, hash), and where each bucket begins in it."""
    bucket = words % np.uint64(buckets)
    order = np.lexsort((words, bucket))
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=np.uint64))


def _numbered(blocks: DataFrame, buckets: int) -> DataFrame:
    """Per (block, bucket): numbers of its words and how often each occurs in training."""

    def ask(batches):
        for batch in batches:
            for row in batch.to_pylist():
                words, endings = unpacked(row["words"], "u8"), unpacked(row["endings"], "u2")
                train = np.repeat(unpacked(row["train"], "u1"), unpacked(row["lengths"], "i8"))
                counts = np.bincount(unpacked(row["tokens"], "u4"), train, len(words))
                order, cuts = _by_bucket(words, buckets)
                out = []
                for k in np.flatnonzero(np.diff(cuts)):
                    at = order[cuts[k] : cuts[k + 1]]
                    out.append((int(k), row["block"], bundle((words[at], "u8"), (endings[at], "u2"), (counts[at], "u4"))))
                yield from _rows(out).to_batches()

    def number(table):
        rows = table.to_pylist()
        parts = [unbundled(r["data"], "u8 u2 u4") for r in rows]
        words, first, back = np.unique(joined([p[0] for p in parts]), return_index=True, return_inverse=True)
        ending = joined([p[1] for p in parts])[first].astype(np.int64)
        count = np.bincount(back, joined([p[2] for p in parts]), len(words)).astype(np.int64)
        order = np.lexsort((words, -count, ending))
        rank = np.empty(len(words), np.int64)
        rank[order] = np.arange(1, len(words) + 1) - np.searchsorted(ending[order], ending[order])
        if rank.max() > NAME // CLASSES - 1:
            raise ValueError("too many words in a bucket")
        name = np.where(count > 0, rank, 0) * CLASSES + ending
        ends = np.cumsum([len(p[0]) for p in parts])[:-1]
        return _rows(
            [
                (r["bucket"], r["block"], bundle((name[at], "i8"), (count[at], "i8")))
                for r, at in zip(rows, np.split(back, ends), strict=True)
            ]
        )

    asked = blocks.mapInArrow(ask, _ROW)
    return asked.groupBy("bucket").applyInArrow(number, _ROW)


@dataclasses.dataclass
class Block:
    """A block read back: its distinct word numbers, ascending, and its distinct pairs, sorted by (word, context)."""

    doc_ids: np.ndarray
    nulls: np.ndarray
    train: np.ndarray
    lengths: np.ndarray
    names: np.ndarray
    counts: np.ndarray
    at: np.ndarray
    pair_word: np.ndarray
    pair_context: np.ndarray
    pair_of: np.ndarray

    @classmethod
    def read(cls, row: dict, numbers: list[dict], buckets: int) -> "Block":
        words, tokens = unpacked(row["words"], "u8"), unpacked(row["tokens"], "u4")
        order, _ = _by_bucket(words, buckets)
        number, count = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        parts = [(r["bucket"], *unbundled(r["data"], "i8 i8")) for r in sorted(numbers, key=lambda r: r["bucket"])]
        number[order] = joined([np.where(name < CLASSES, name, name | k << BUCKET_SHIFT) for k, name, _ in parts])
        count[order] = joined([n for _, _, n in parts])
        names, first, place = np.unique(number, return_index=True, return_inverse=True)
        at = place[tokens]
        # Before a text's first token is the end of the text before it, or of the block's last.
        pairs, pair_of = np.unique(at * len(names) + np.roll(at, 1), return_inverse=True)
        return cls(
            unpacked(row["doc_ids"], "i8"), unpacked(row["nulls"], "u1"), unpacked(row["train"], "u1"), unpacked(row["lengths"], "i8"),
            names, count[first], at, pairs // len(names), pairs % len(names), pair_of.astype(np.uint32),
        )

    def in_training(self) -> np.ndarray:
        return np.repeat(self.train, self.lengths).astype(bool)

    def known(self) -> np.ndarray:
        return self.names & NAME >= CLASSES


def _requests(blocks: DataFrame, numbers: DataFrame, buckets: int) -> DataFrame:
    """Per (block, bucket): distinct known words, how many contexts each, the contexts and training counts."""

    def run(left, right):
        out = []
        for row in left.to_pylist():
            b = Block.read(row, right.to_pylist(), buckets)
            counts = np.bincount(b.pair_of, b.in_training(), len(b.pair_word))
            sizes = np.bincount(b.pair_word, minlength=len(b.names))
            word_cut = np.searchsorted(b.names, np.arange(buckets + 1) << BUCKET_SHIFT)
            word_cut[0] = len(b.names) - b.known().sum() if len(b.names) else 0
            pair_cut = np.r_[0, np.cumsum(sizes)][word_cut]
            for k in np.flatnonzero(np.diff(word_cut)):
                w, p = slice(word_cut[k], word_cut[k + 1]), slice(pair_cut[k], pair_cut[k + 1])
                out.append(
                    (int(k), row["block"], bundle((np.diff(b.names[w] & NAME, prepend=0), "i8"), (sizes[w], "u4"),
                     (b.names[b.pair_context[p]], "i8"), (counts[p], "u4")))
                )
        return _rows(out)

    return laid(blocks.groupBy("block").cogroup(numbers.groupBy("block")).applyInArrow(run, _ROW), buckets, "bucket")


@dataclasses.dataclass
class Bucket:
    """All (word, class) pairs of some words with their customers; seating is sampled from them."""

    words: np.ndarray
    starts: np.ndarray
    word: np.ndarray
    context: np.ndarray
    count: np.ndarray

    def sums(self, x: np.ndarray) -> np.ndarray:
        return np.bincount(self.word, x, len(self.words))


@dataclasses.dataclass
class Pairs:
    """What blocks ask of a bucket, and the (word, context) pairs of it seen in training, by (word, class, context)."""

    rows: list[dict]
    words: np.ndarray
    contexts: np.ndarray
    sizes: list[np.ndarray]
    places: list[np.ndarray]
    asked: np.ndarray
    """Keys of the pairs asked for, row by row."""
    keys: np.ndarray
    count: np.ndarray

    @classmethod
    def read(cls, rows: list[dict]) -> "Pairs":
        parts = [unbundled(r["data"], "i8 u4 i8 u4") for r in rows]
        words, place = np.unique(joined([np.cumsum(p[0]) for p in parts]), return_inverse=True)
        contexts, context = np.unique(joined([p[2] for p in parts]), return_inverse=True)
        word = np.repeat(place, joined([p[1] for p in parts]).astype(np.int64))
        asked = (word * CLASSES + (contexts & NAME)[context] % CLASSES) * len(contexts) + context
        counts = joined([p[3] for p in parts])
        seen = counts > 0
        keys, at = np.unique(asked[seen], return_inverse=True)
        count = np.bincount(at, counts[seen], len(keys)).astype(np.int64)
        ends = np.cumsum([len(p[0]) for p in parts])[:-1]
        return cls(rows, words, contexts, [p[1] for p in parts], np.split(place, ends), asked, keys, count)

    def cells(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct (word, class) pairs, as word * CLASSES + class, and that of each pair."""
        return np.unique(self.keys // max(1, len(self.contexts)), return_inverse=True)


@dataclasses.dataclass
class Leaves:
    """Pairs of a bucket with more than one customer; a context's tables may be more, in other buckets."""

    cell: np.ndarray
    count: np.ndarray
    tables: np.ndarray
    totals: np.ndarray
    """Tables of the pair's context."""


@dataclasses.dataclass
class Totals:
    """After a sweep: tables per class, tables of the root, customers per class (none given: those of the model)."""

    tables: np.ndarray
    root_tables: float
    customers: np.ndarray | None = None


@dataclasses.dataclass
class Seats:
    """A bucket after a sweep: customers and tables per (word, class), root customers and tables per word."""

    sweep: int
    customers: np.ndarray
    tables: np.ndarray
    at_root: np.ndarray
    root_tables: np.ndarray


@dataclasses.dataclass
class Model:
    known: int
    tokens: int
    customers: np.ndarray
    discount: float
    root_discount: float
    history: list[Totals]
    word_discount: float = 0.5

    def base(self) -> float:
        return 1.0 / (self.known + 1)

    def root(self, customers: np.ndarray, tables: np.ndarray, after: Totals) -> np.ndarray:
        """The root's probability of words with so many customers and tables there."""
        rest = (STRENGTH + self.root_discount * after.root_tables) * self.base()
        return (customers - self.root_discount * tables + rest) / (STRENGTH + after.tables.sum())

    def shared(self, kind: np.ndarray, customers: np.ndarray, tables: np.ndarray, parent: np.ndarray, after: Totals) -> np.ndarray:
        """The probability in classes of words with so many customers and tables there and such a one at the root."""
        all_customers = self.customers if after.customers is None else after.customers
        rest = (STRENGTH + self.discount * after.tables[kind]) * parent
        return (customers - self.discount * tables + rest) / (STRENGTH + all_customers[kind])

    def sweeps(self, b: Bucket, bucket: int, sweeps: int, seats: Seats | None = None, leaves: Leaves | None = None):
        """(tables per pair, root customers and tables per word) after each sweep, from the totals before it.

        Goes on from ``seats``, which it keeps up to date; at the start each pair has one table.  The customers of
        a pair are ``b.count``, and the further tables of ``leaves`` below it.
        """
        seats = seats or start(b)
        for s in range(seats.sweep, seats.sweep + sweeps):
            rng = np.random.default_rng([SEED, s, bucket])
            before = self.history[s]
            parent = self.root(seats.at_root, seats.root_tables, before)
            if leaves:
                shared = self.shared(b.context, seats.customers, seats.tables, parent[b.word], before)
                lure = (STRENGTH + self.word_discount * leaves.totals) * shared[leaves.cell]
                leaves.tables = seated(leaves.count, lure, self.word_discount, rng)
                seats.customers = b.count + np.bincount(leaves.cell, leaves.tables - 1, len(b.count)).astype(np.int64)
            lure = (STRENGTH + self.discount * before.tables[b.context]) * parent[b.word]
            seats.tables = seated(seats.customers, lure, self.discount, rng)
            seats.at_root = b.sums(seats.tables)
            lure = np.full(len(seats.at_root), (STRENGTH + self.root_discount * before.root_tables) * self.base())
            seats.root_tables = seated(seats.at_root.astype(np.int64), lure, self.root_discount, rng)
            seats.sweep = s + 1
            yield seats.tables, seats.at_root, seats.root_tables


def start(b: Bucket) -> Seats:
    """One table for every dish."""
    at_root = b.sums(np.ones(len(b.count)))
    return Seats(0, b.count, np.ones(len(b.count)), at_root, np.minimum(at_root, 1.0))


def seated(customers: np.ndarray, lure: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of dishes whose customers come in one after the other.

    With n seated at t tables the next takes a new one with odds ``lure`` to n - discount * t.  No chance to come is
    above the present one unless a table is added, nor then, as it brings a customer.  So geometric draws at
    the present chance lead from one who may take a table to the next, over as many customers as
    are seated, and each does with the ratio of their own chance to that.  Who does depends on the tables before:
    it is reckoned from no new tables, then from those found, until nothing changes, first ones first.
    Every customer is seated by the exact odds.
    """
    tables = np.minimum(customers, 1).astype(np.float64)
    live = np.flatnonzero(customers > 1)
    n = np.ones(len(live))
    while len(live):
        pull, mine = lure[live], tables[live]
        chance = pull / (pull + n - discount * mine)
        run = np.minimum(n, customers[live] - n)
        draws = np.ceil(run * chance).astype(np.int64) + 1
        of = np.repeat(np.arange(len(live)), draws)
        ends = np.cumsum(draws)
        # A gap beyond the run is as good as one just beyond it.
        gaps = np.minimum(rng.geometric(np.maximum(chance, 1e-18)[of]), run[of] + 1)
        place = np.cumsum(gaps)
        place -= np.r_[0.0, place[ends[:-1] - 1]][of]
        run = np.minimum(run, place[ends - 1])
        asked = place <= run[of]
        of, place = of[asked], place[asked]
        mark = rng.random(len(of)) * chance[of]
        first = np.searchsorted(of, np.arange(len(live)))
        new = np.zeros(len(of), bool)
        while True:
            before = np.r_[0, np.cumsum(new)]
            more = before[:-1] - before[first][of]
            found = mark * (pull[of] + n[of] + place - 1 - discount * (mine[of] + more)) < pull[of]
            if (found == new).all():
                break
            new = found
        tables[live] += np.bincount(of[new], minlength=len(live))
        n += run
        left = n < customers[live]
        live, n = live[left], n[left]
    return tables


FIXED, SUMS, SEATED, OWN = -1, -2, -3, -4
"""What a row of a bucket holds, where it is no message of another bucket (from 0 on) or block."""

SLOTS = ("known", "tokens", "once", "twice", "class_once", "class_twice", "root_once", "root_twice", "root_tables")


def _messages(bucket: int, names: np.ndarray, sums: np.ndarray, wanted: np.ndarray) -> list[tuple]:
    """A row for each bucket whose words are among ``names``: the bucket's tables of them, and if it wants all."""
    homes = names >> BUCKET_SHIFT
    ends = np.flatnonzero(np.diff(homes, append=-1)) + 1
    return [
        (int(homes[low]), bucket, bundle((np.diff(names[low:high] & NAME, prepend=0), "i8"), (sums[low:high], "i8"), (wanted[low:high], "u1")))
        for low, high in zip(np.r_[0, ends][:-1], ends, strict=True)
    ]


def _sums(bucket: int, cells: Bucket, seats: Seats, **more: float) -> tuple:
    """A row of what the driver adds up: customers and tables per class, then what belongs to no class."""
    by_class = [np.bincount(cells.context, x, CLASSES) for x in (seats.customers, seats.tables)]
    more["root_tables"] = seats.root_tables.sum()
    return bucket, SUMS, bundle((np.concatenate([*by_class, [more.get(x, 0) for x in SLOTS]]), "f8"))


def _of(rows: list[dict], kind: int) -> list[dict]:
    return [r for r in rows if r["block"] == kind]


def _gathered(found: DataFrame) -> tuple[np.ndarray, np.ndarray, dict[str, float]]:
    """Customers per class, tables per class and the other sums over all buckets."""

    def run(batches):
        total = np.zeros(2 * CLASSES + len(SLOTS))
        for batch in batches:
            for data in batch.column("data").to_pylist():
                total += unpacked(data[0], "f8")
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], names=["slot", "x"])

    rows = found.filter(F.col("block") == SUMS).mapInArrow(run, "slot long, x double").groupBy("slot").agg(F.sum("x").alias("x"))
    total = np.zeros(2 * CLASSES + len(SLOTS))
    for r in rows.collect():
        total[r.slot] = r.x
    return total[:CLASSES], total[CLASSES : 2 * CLASSES], dict(zip(SLOTS, total[2 * CLASSES :].tolist(), strict=True))


def _discount(once: float, twice: float) -> float:
    """The usual estimate from how many dishes have one and two customers."""
    return min(0.95, max(0.05, once / (once + 2 * twice))) if once + twice else 0.5


def _first(table: pa.Table) -> pa.Table:
    """A bucket before the first sweep: what of it the sweeps need, every context's number of words, sums."""
    rows = table.to_pylist()
    bucket, p = rows[0]["bucket"], Pairs.read(rows)
    cells, cell = p.cells()
    b = Bucket(p.words, np.zeros(0), cells // CLASSES, cells % CLASSES, np.bincount(cell, minlength=len(cells)))
    context = p.keys % max(1, len(p.contexts))
    many = np.flatnonzero(p.count > 1)
    asked, at = np.unique(context[many], return_inverse=True)
    of = np.bincount(context, minlength=len(p.contexts))
    wanted = np.zeros(len(of), bool)
    wanted[asked] = True
    seen = of > 0
    kinds = b.sums(np.ones(len(b.count)))
    fixed = bundle(
        ([len(np.unique(b.word))], "i8"), (np.diff(cells, prepend=0), "i8"), (b.count, "i8"),
        (np.diff(cell[many], prepend=0), "i8"), (p.count[many], "i8"), (at, "i8"), (p.contexts[asked], "i8"),
    )
    sums = _sums(
        bucket, b, start(b), known=len(np.unique(b.word)), tokens=p.count.sum(), once=(p.count == 1).sum(), twice=(p.count == 2).sum(),
        class_once=(b.count == 1).sum(), class_twice=(b.count == 2).sum(), root_once=(kinds == 1).sum(), root_twice=(kinds == 2).sum(),
    )
    return _rows([(bucket, FIXED, fixed), sums, *_messages(bucket, p.contexts[seen], of[seen], wanted[seen])])


def _replies(found: DataFrame) -> DataFrame:
    """Each bucket's answers to messages: the sums of all, for those wanted; and its words' sums for itself."""

    def run(table):
        rows = table.to_pylist()
        bucket = rows[0]["bucket"]
        parts = [unbundled(r["data"], "i8 i8 u1") for r in rows]
        names, place = np.unique(joined([np.cumsum(p[0]) for p in parts]), return_inverse=True)
        sums = np.bincount(place, joined([p[1] for p in parts]), len(names)).astype(np.int64)
        out = [(bucket, OWN, bundle((np.diff(names, prepend=0), "i8"), (sums, "i8")))]
        for r, p, at in zip(rows, parts, np.split(place, np.cumsum([len(p[0]) for p in parts])[:-1]), strict=True):
            if p[2].any():
                out.append((r["block"], bucket, bundle((sums[at[p[2] > 0]], "i8"))))
        return _rows(out)

    return found.filter("block >= 0").groupBy("bucket").applyInArrow(run, _ROW)


def _sweep(model: Model):
    """Makes a bucket after one more sweep: its seats, its further tables of each context, sums."""
    return lambda left, right: _swept(model, left, right.to_pylist())


def _swept(model: Model, left: pa.Table, right: list[dict]) -> pa.Table:
    if not len(left):
        return _rows([])
    bucket, data = left["bucket"][0].as_py(), left["data"][0].as_py()
    words, cells, count, many, customers, at, names = unbundled(data, "i8 i8 i8 i8 i8 i8 i8")
    cells = np.cumsum(cells)
    b = Bucket(np.arange(words[0]), np.zeros(0), cells // CLASSES, cells % CLASSES, count)
    told = joined([unpacked(r["data"][0], "i8") for r in sorted(right, key=lambda r: r["block"]) if r["block"] >= 0])
    seats, tables, least = start(b), np.ones(len(many)), told
    for r in _of(right, SEATED):
        sweep, tables, least, *rest = unbundled(r["data"], "i8 f8 i8 i8 f8 f8 f8")
        seats = Seats(int(sweep[0]), *rest)
        told = least + told
    leaves = Leaves(np.cumsum(many), customers, tables, told[at])
    for _ in model.sweeps(b, bucket, 1, seats, leaves):
        pass
    further = np.bincount(at, leaves.tables - 1, len(names)).astype(np.int64)
    state = bundle(
        ([seats.sweep], "i8"), (leaves.tables, "f8"), (least, "i8"), (seats.customers, "i8"), (seats.tables, "f8"),
        (seats.at_root, "f8"), (seats.root_tables, "f8"),
    )
    return _rows([(bucket, SEATED, state), _sums(bucket, b, seats), *_messages(bucket, names, further, np.ones(len(names)))])


def fit(requests: DataFrame, buckets: int, sweeps: int = SWEEPS, burn_in: int = BURN_IN) -> tuple[Model, DataFrame]:
    """The model's counts, discounts and totals after each sweep; what buckets know of the sweeps after ``burn_in``.

    The driver sees a few numbers per class.
    """
    found = laid(requests.groupBy("bucket").applyInArrow(_first, _ROW), buckets, "bucket")
    customers, tables, more = _gathered(found)
    model = Model(
        int(more["known"]), int(more["tokens"]), customers, _discount(more["class_once"], more["class_twice"]),
        _discount(more["root_once"], more["root_twice"]), [Totals(tables, more["root_tables"])], _discount(more["once"], more["twice"]),
    )
    fixed = found.filter(F.col("block") == FIXED)
    replies = laid(_replies(found), buckets, "bucket")
    own, kept = F.col("block") == OWN, []
    after = replies.filter(own)
    for s in range(1, sweeps + 1):
        known = replies.filter("block >= 0")
        if s > 1:
            known = known.union(found.filter(F.col("block") == SEATED))
        swept = fixed.groupBy("bucket").cogroup(known.groupBy("bucket")).applyInArrow(_sweep(model), _ROW)
        found = laid(swept, buckets, "bucket")
        customers, tables, more = _gathered(found)
        replies = laid(_replies(found), buckets, "bucket")
        model = dataclasses.replace(model, history=[*model.history, Totals(tables, more["root_tables"], customers)])
        if s > burn_in:
            kept.append((s, found, replies))
    # Kinds of a sweep's rows are its number times 8 apart.
    for s, found, replies in kept:
        some = found.filter(F.col("block") == SEATED).union(replies.filter(own))
        after = after.union(some.select("bucket", (F.col("block") - 8 * s).alias("block"), "data"))
    return model, after


def _answers(requests: DataFrame, after: DataFrame, sweeps: range) -> DataFrame:
    """Per (block, bucket), after each of the sweeps: tables of the words as contexts; root customers and tables of the
    words; customers and tables of their classes; customers and tables of the pairs."""

    def run(left, right):
        rows, right = left.to_pylist(), right.to_pylist()
        if not rows:
            return _rows([])
        bucket, p = rows[0]["bucket"], Pairs.read(rows)
        cells, cell = p.cells()
        many = np.flatnonzero(p.count > 1)
        trained = np.unique(cells // CLASSES)

        def of_words(kind: int) -> np.ndarray:
            out = np.zeros(len(p.words), np.int64)
            for r in _of(right, kind):
                names, sums = unbundled(r["data"], "i8 i8")
                out[np.searchsorted(p.words, np.cumsum(names))] = sums
            return out

        least = of_words(OWN)
        per_word, per_cell, per_pair = [], [], [np.r_[p.count, 0]]
        for s in sweeps:
            per_word.append(least + of_words(OWN - 8 * s))
            tables, root = np.ones(len(p.keys) + 1), np.zeros((2, len(p.words)))
            tables[-1] = 0
            for r in _of(right, SEATED - 8 * s):
                _, further, _, customers, shared, at_root, root_tables = unbundled(r["data"], "i8 f8 i8 i8 f8 f8 f8")
                tables[many] = further
                root[:, trained] = at_root, root_tables
                per_cell += [np.r_[customers, 0], np.r_[shared, 0]]
            per_word += [*root]
            per_pair.append(tables)
        out, low = [], 0
        of_key = _places(p.keys, p.asked)
        of_cell = p.asked // max(1, len(p.contexts))
        for row, sizes, place in zip(rows, p.sizes, p.places, strict=True):
            high = low + int(sizes.sum())
            pair = of_key[low:high]
            shared = _places(cells, np.unique(of_cell[low:high]))
            out.append(
                (bucket, row["block"], bundle(*((x[place], "i8") for x in per_word), *((x[shared], "i8") for x in per_cell),
                 *((x[pair], "i8") for x in per_pair)))
            )
            low = high
        return _rows(out)

    return requests.groupBy("bucket").cogroup(after.groupBy("bucket")).applyInArrow(run, _ROW)


def _places(keys: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Where each asked key is among the sorted ones; their number if it isn't."""
    at = np.searchsorted(keys, asked)
    hit = at < len(keys)
    hit[hit] = keys[at[hit]] == asked[hit]
    return np.where(hit, at, len(keys))


def _pair_scores(b: Block, answers: list[dict], model: Model, sweeps: range) -> np.ndarray:
    """The log10 probability of each pair of a block, averaged over the sweeps."""
    n, known = 3 * len(sweeps), b.known()
    kinds = " ".join(["i8"] * (6 * len(sweeps) + 1))
    parts = [unbundled(r["data"], kinds) for r in sorted(answers, key=lambda r: r["bucket"])]
    got = [joined([p[i] for p in parts]) for i in range(6 * len(sweeps) + 1)]
    kind = b.names[b.pair_context] % (1 << BUCKET_SHIFT) % CLASSES
    cells, cell = np.unique(b.pair_word * CLASSES + kind, return_inverse=True)
    cell_word, cell_kind = cells // CLASSES, cells % CLASSES
    # Words without a number come first, and were not asked for: no customers, no tables.
    whole = lambda x, size: np.r_[np.zeros(size - len(x)), x]
    customers, total = whole(got[n + 2 * len(sweeps)], len(b.pair_word)), np.zeros(len(b.pair_word))
    for i, s in enumerate(sweeps):
        after = model.history[s]
        tables, at_root, root_tables = (whole(x, len(known)) for x in got[3 * i : 3 * i + 3])
        in_class, class_tables = (whole(x, len(cells)) for x in got[n + 2 * i : n + 2 * i + 2])
        parent = model.root(at_root, root_tables, after)
        shared = model.shared(cell_kind, in_class, class_tables, parent[cell_word], after)
        own = customers - model.word_discount * whole(got[n + 2 * len(sweeps) + 1 + i], len(customers))
        rest = (STRENGTH + model.word_discount * tables)[b.pair_context] * shared[cell]
        total += (own + rest) / (STRENGTH + b.counts[b.pair_context])
    return np.log10(total / len(sweeps))


_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(
    docs: DataFrame,
    folds: int = 5,
    out_fold: int = 1,
    sweeps: int = SWEEPS,
    burn_in: int = BURN_IN,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Per row of ``docs``: its tokens, its score under the unigram base and under the model.

    Learns from rows whose fold, CRC-32 of the id as text modulo ``folds``, is not ``out_fold``.
    A-Z are lowered, words are what stands between ASCII white space, an end token follows.
    Null texts count as empty: the end token alone.  A null id folds like the empty text.
    Repeated rows are learnt from and scored each.  No training rows leave one unknown word
    of probability one; no rows give no rows.  Other columns are ignored.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets, tasks = max(least, size // BUCKET_BYTES), max(least, size // max(block_bytes, BLOCK_BYTES))
    blocks = _blocks(docs, folds, out_fold, block_bytes, tasks)
    numbers = laid(_numbered(blocks, buckets), tasks, "block")
    requests = _requests(blocks, numbers, buckets)
    model, after = fit(requests, buckets, sweeps, burn_in)
    kept = range(burn_in + 1, sweeps + 1)
    answers = _answers(requests, after, kept)
    floor = math.log10(model.tokens + 0.5 * (model.known + 1))
    fields = _SCORES.split(", ")
    schema = pa.schema([(n, {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}[t]) for n, t in map(str.split, fields)])

    def gathered(left, right):
        if not len(left):
            return schema.empty_table()
        right = right.to_pylist()
        b = Block.read(left.to_pylist()[0], [r for r in right if not r["is_answer"]], buckets)
        logs = _pair_scores(b, [r for r in right if r["is_answer"]], model, kept)
        starts = np.r_[0, np.cumsum(b.lengths)[:-1]]
        sums = [np.add.reduceat(x[at], starts) for x, at in (
            ((b.counts > 0).astype(np.int64), b.at), (np.log10(b.counts + 0.5) - floor, b.at), (logs, b.pair_of)
        )]
        return pa.table(
            [
                pa.array(b.doc_ids, mask=b.nulls == 1), b.train == 0, b.lengths, sums[0],
                np.full(len(b.lengths), model.tokens), sums[1], sums[2],
            ],
            schema=schema,
        )

    told = numbers.withColumn("is_answer", F.lit(False)).union(answers.withColumn("is_answer", F.lit(True)))
    return blocks.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(gathered, _SCORES)
