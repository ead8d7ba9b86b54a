"""Conversations rebuilt over shared heads and gathered in double-array tries, one row per distinct prefix.

A rebuilt conversation is cut into *segments* of ``SEGMENT`` turns; a segment is keyed by the digest of
all turns before it, so equal prefixes have equal keys however long the conversations are.  Equal
segments are counted before they meet.  The distinct ones are dealt out in the order of
(key, turns), and every run of neighbours is a prefix shard: its turns get dense ids, its prefixes are packed into
a BASE and a CHECK array, and walking those arrays gives the shard's nodes with their totals.

Only the nodes on the first and the last path of a run can be shared with another run.  They come
out *open*, with what their complete parts add up to, and are merged by digest; all other nodes are
complete.  Nodes below the first segment are added to those above by doubling: after k rounds a
segment's total reaches 2^k segments up, so the rounds grow with the logarithm of the longest conversation.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stationlab.llm.common import broadcast_if_small, cut, encoded

SEGMENT = 64
SYMBOL = 24
"""Bytes of a turn in a path: 16 of its digest, then the UTF-8 length of its text."""
RUN_SYMBOLS = 1 << 16
"""Turns of the distinct segments that share a double array."""
HEADS = 9
"""Heads have fewer turns than this."""
FAMILY = 5
ID_TEXT = 1 << 16
"""Bytes of joined ids that travel as one row."""
KEY_BYTES = 64
_TRIES = 16
_NONE = hashlib.sha256(b"").hexdigest()
_NODES = (
    "open boolean, root boolean, key binary, up binary, conv_id long, depth long, parent_conv_id long, n_convs long, "
    "n_children long, n_leaves long, saved_tokens long, ends_sha256 string, size long, passing long, above array<binary>"
)
COLUMNS = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()


# --- rebuilt conversations --------------------------------------------------------------------


def _numbered(conversations: DataFrame) -> DataFrame:
    """Turns in order: conv_id, part, at (from 1 within a conversation's rows of a part), symbol.

    The sort is by range, so a conversation of very many turns is spread over parts.
    """

    def run(batches):
        part, last, at = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            convs = batch.column("conv_id").to_pylist()
            places, symbols = [], []
            for conv, role, text in zip(convs, encoded(batch.column("role")), encoded(batch.column("text")), strict=True):
                at = at + 1 if conv == last else 1
                last = conv
                places.append(at)
                digest = hashlib.blake2b(b"%d:" % len(role) + role + text, digest_size=16).digest()
                symbols.append(digest + len(text).to_bytes(8, "big"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), pa.array([part] * len(convs), pa.int32()), pa.array(places, pa.int64()), pa.array(symbols, pa.binary())],
                names=["conv_id", "part", "at", "symbol"],
            )

    empty = F.lit("")
    rows = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long"), "turn", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text")
    )
    order = "conv_id", "turn", "role", "text"
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "role", "text")
    return cut(ordered.mapInArrow(run, "conv_id long, part int, at long, symbol binary"))


def _digest(level: Column, first: Column, second: Column) -> Column:
    return F.unhex(F.md5(F.concat_ws(":", *(x.cast("string") for x in (level, first, second))).cast("binary")))


def segments(conversations: DataFrame) -> DataFrame:
    """The rebuilt conversations: conv_id, level (from 0), key (of all turns before), path, end (key after it), more.

    Conversation c opens with the first h turns of c - c % 5 (those there are; none if it is absent), h the
    CRC-32 of its decimal id modulo 9, and goes on with its own turns after its first h.  One without turns has
    one segment with an empty path.
    """
    numbered = _numbered(conversations)
    per_part = numbered.groupBy("conv_id", "part").agg(F.max("at").alias("_n"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = per_part.withColumn("_before", F.sum("_n").over(earlier)).filter("_before is not null").drop("_n")
    # One row for each part that goes on with the conversation of the part before: as many as parts at most.
    placed = numbered.join(broadcast_if_small(cut(before), KEY_BYTES), ["conv_id", "part"], "left").select(
        "conv_id", (F.col("at") + F.coalesce("_before", F.lit(0))).alias("pos"), "symbol"
    )
    sizes = per_part.groupBy("conv_id").agg(F.sum("_n").alias("_n"))
    base, h = F.col("conv_id") - F.col("conv_id") % FAMILY, F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS
    heads = placed.filter((F.col("pos") < HEADS) & (F.col("conv_id") % FAMILY == 0)).groupBy(F.col("conv_id").alias("_base"))
    heads = heads.agg(F.sort_array(F.collect_list(F.struct("pos", "symbol"))).alias("_head"))
    known = sizes.withColumns({"_base": base, "_h": h}).join(heads, "_base", "left")
    head = F.when(F.col("_h") > 0, F.slice(F.coalesce("_head", F.array().cast("array<struct<pos:bigint,symbol:binary>>")), 1, F.greatest("_h", F.lit(1))))
    known = known.withColumn("_head", F.coalesce(head, F.array().cast("array<struct<pos:bigint,symbol:binary>>")))
    known = known.withColumn("_long", F.size("_head") + F.greatest(F.col("_n") - F.col("_h"), F.lit(0)))
    known = cut(known.select("conv_id", "_h", "_head", "_long"))
    shared = known.select("conv_id", "_long", F.inline("_head"))
    own = placed.join(known.select("conv_id", "_h", "_long", F.size("_head").alias("_kept")), "conv_id").filter("pos > _h")
    own = own.select("conv_id", "_long", (F.col("pos") - F.col("_h") + F.col("_kept")).alias("pos"), "symbol")
    level = F.floor((F.col("pos") - 1) / SEGMENT).cast("long").alias("level")
    cuts = shared.union(own).groupBy("conv_id", "_long", level).agg(F.sort_array(F.collect_list(F.struct("pos", "symbol"))).alias("_turns"))
    path = F.expr("aggregate(_turns, cast('' as binary), (a, t) -> concat(a, t.symbol))").alias("path")
    cuts = cuts.select("conv_id", "_long", "level", path).union(
        known.filter("_long = 0").select("conv_id", "_long", F.lit(0).cast("long"), F.lit(b""))
    )
    whole = F.sha2(F.concat(F.col("level").cast("string").cast("binary"), F.lit(b":"), F.col("path")), 256)
    for name, at in (("_a", 1), ("_b", 16)):
        cuts = cuts.withColumn(name, F.conv(F.substring(whole, at, 15), 16, 10).cast("decimal(38,0)"))
    zero = F.lit(0).cast("decimal(38,0)")
    line = Window.partitionBy("conv_id").orderBy("level").rowsBetween(Window.unboundedPreceding, -1)
    sums = {f"{x}0": F.coalesce(F.sum(x).over(line), zero).cast("decimal(38,0)") for x in ("_a", "_b")}
    several = cuts.filter(F.col("_long") > SEGMENT).withColumns(sums)
    alone = cuts.filter(F.col("_long") <= SEGMENT).withColumns({"_a0": zero, "_b0": zero})
    return cut(
        alone.union(several).select(
            "conv_id",
            "level",
            _digest(F.col("level"), F.col("_a0"), F.col("_b0")).alias("key"),
            "path",
            _digest(F.col("level") + 1, (F.col("_a0") + F.col("_a")).cast("decimal(38,0)"), (F.col("_b0") + F.col("_b")).cast("decimal(38,0)")).alias("end"),
            (F.col("_long") > SEGMENT * (F.col("level") + 1)).alias("more"),
        )
    )


def id_digests(pairs: DataFrame) -> DataFrame:
    """(end, ids): the SHA-256 of each key's conv_ids, ascending, comma-joined.

    Ids are joined where the sort puts them; one task then hashes a key's text as a stream, a row per 64 KiB.
    """

    def joined(batches):
        end, ids, size = None, [], 0

        def row():
            return pa.RecordBatch.from_pydict({"end": [end], "first": [int(ids[0])], "ids": [",".join(ids)]}, schema=schema)

        schema = pa.schema([("end", pa.binary()), ("first", pa.int64()), ("ids", pa.string())])
        done: list = [[], [], []]
        for batch in batches:
            for key, conv in zip(batch.column("end").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
                if ids and (key != end or size >= ID_TEXT):
                    for column, value in zip(done, (end, int(ids[0]), ",".join(ids)), strict=True):
                        column.append(value)
                    ids, size = [], 0
                    if len(done[0]) >= 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(done, schema.types, strict=True)], schema=schema)
                        done = [[], [], []]
                end = key
                ids.append(str(conv))
                size += len(ids[-1]) + 1
        if done[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(done, schema.types, strict=True)], schema=schema)
        if ids:
            yield row()

    def hashed(batches):
        end, state = None, None
        for batch in batches:
            done: list = [[], []]
            for key, text in zip(batch.column("end").to_pylist(), encoded(batch.column("ids")), strict=True):
                if key == end:
                    state.update(b"," + text)
                    continue
                if state is not None:
                    done[0].append(end)
                    done[1].append(state.hexdigest())
                end, state = key, hashlib.sha256(text)
            yield pa.RecordBatch.from_arrays([pa.array(done[0], pa.binary()), pa.array(done[1], pa.string())], names=["end", "ends"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([end], pa.binary()), pa.array([state.hexdigest()])], names=["end", "ends"])

    parts = pairs.repartitionByRange("end", "conv_id").sortWithinPartitions("end", "conv_id").select("end", "conv_id")
    parts = parts.mapInArrow(joined, "end binary, first long, ids string")
    return parts.repartition("end").sortWithinPartitions("end", "first").mapInArrow(hashed, "end binary, ends string")


# --- double arrays ----------------------------------------------------------------------------


class DoubleArray:
    """BASE and CHECK: the child of state s by code c is slot t = BASE[s] + c where CHECK[t] = s.  State 0 is the root."""

    def __init__(self):
        self.base = np.zeros(1024, np.int64)
        self.check = np.full(1024, -1, np.int64)
        self.check[0] = -2
        self.top = 1
        self.low = 1

    def _room(self, slots: int) -> None:
        if slots > len(self.check):
            grow = max(slots, 2 * len(self.check)) - len(self.check)
            self.base = np.append(self.base, np.zeros(grow, np.int64))
            self.check = np.append(self.check, np.full(grow, -1, np.int64))

    def _free(self, n: int) -> np.ndarray:
        """The first free slots, up to n of them below the top."""
        return self.low + np.flatnonzero(self.check[self.low : self.top] == -1)[:n]

    def add(self, states: np.ndarray, codes: np.ndarray) -> None:
        """All children of some states at once: distinct (state, code) pairs, ordered."""
        parents, first, count = np.unique(states, return_index=True, return_counts=True)
        for parent, at, n in sorted(zip(parents, first, count, strict=True), key=lambda x: -x[2]):
            if n == 1:
                break
            own = codes[at : at + n]
            for slot in [*self._free(_TRIES), self.top]:
                base = slot - own[0]
                self._room(int(base + own[-1]) + 1)
                if (self.check[base + own] == -1).all():
                    break
            self.base[parent] = base
            self.check[base + own] = parent
            self.top = max(self.top, int(base + own[-1]) + 1)
        alone = count == 1
        slots = self._free(int(alone.sum()))
        fresh = int(alone.sum()) - len(slots)
        self._room(self.top + fresh)
        slots = np.append(slots, np.arange(self.top, self.top + fresh))
        self.top += fresh
        self.base[parents[alone]] = slots - codes[first[alone]]
        self.check[slots] = parents[alone]
        free = self._free(1)
        self.low = int(free[0]) if len(free) else self.top

    def step(self, states: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The children of states by codes, -1 where there is none."""
        slots = self.base[states] + codes
        inside = (slots > 0) & (slots < self.top)
        return np.where(inside & (self.check[np.where(inside, slots, 0)] == states), slots, -1)


def pack(codes: np.ndarray, size: np.ndarray) -> DoubleArray:
    """The trie of code rows (one column a level, ``size`` of them used) as a double array."""
    trie = DoubleArray()
    state = np.zeros(len(codes), np.int64)
    width = int(codes.max(initial=0)) + 1
    for d in range(int(size.max(initial=0))):
        on = np.flatnonzero(size > d)
        pairs = np.unique(state[on] * width + codes[on, d])
        trie.add(pairs // width, pairs % width)
        state[on] = trie.step(state[on], codes[on, d])
    return trie


def _shard(rows: list[dict]) -> pa.RecordBatch:
    """The nodes of a run of distinct segments in order, its first and last path open."""
    size = np.array([1 + len(r["path"]) // SYMBOL for r in rows])
    turns = np.frombuffer(b"".join(r["path"] for r in rows), f"S{SYMBOL}")
    kinds, dense = np.unique(turns, return_inverse=True)
    roots = {key: len(kinds) + 1 + k for k, key in enumerate(sorted({r["key"] for r in rows}))}
    codes = np.zeros((len(rows), int(size.max())), np.int64)
    codes[:, 0] = [roots[r["key"]] for r in rows]
    inside = np.arange(codes.shape[1])[None, :] < size[:, None]
    inside[:, 0] = False
    codes[inside] = dense + 1
    trie = pack(codes, size)
    # Of each slot: what the walk of all paths adds up.
    n, passing, below = (np.zeros(trie.top, np.int64) for _ in range(3))
    conv = np.full(trie.top, np.iinfo(np.int64).max)
    level, depth, width, children, leaves, saved = (np.zeros(trie.top, np.int64) for _ in range(6))
    ends = np.full(trie.top, _NONE, object)
    column = {x: np.array([r[x] or 0 for r in rows], np.int64) for x in ("n", "level", "passing", "b_children", "b_leaves", "b_saved")}
    convs = np.array([r["conv_id"] for r in rows], np.int64)
    lengths = np.array([0, *(int.from_bytes(x.ljust(SYMBOL, b"\0")[16:], "big") for x in kinds.tolist())] + [0] * len(roots), np.int64)
    state, slots, first_path, last_path = np.zeros(len(rows), np.int64), [], [], []
    for d in range(codes.shape[1]):
        on = np.flatnonzero(size > d)
        state[on] = trie.step(state[on], codes[on, d])
        at = state[on]
        np.add.at(n, at, column["n"][on])
        np.minimum.at(conv, at, convs[on])
        level[at], depth[at], width[at] = column["level"][on], d, lengths[codes[on, d]]
        slots.append(np.unique(at))
        last = on[size[on] == d + 1]  # a distinct segment ends here, alone
        passing[state[last]], below[state[last]] = column["passing"][last], column["b_children"][last]
        leaves[state[last]], saved[state[last]] = column["b_leaves"][last], column["b_saved"][last]
        for i in last:
            if rows[i]["ends"]:
                ends[state[i]] = rows[i]["ends"]
        if size[0] > d:
            first_path.append(int(state[0]))
        if size[-1] > d:
            last_path.append(int(state[-1]))
    open_ = np.zeros(trie.top, bool)
    open_[first_path + last_path] = True
    keys: dict[int, bytes] = {}
    above: dict[int, list[bytes]] = {}
    for path, row in ((first_path, rows[0]), (last_path, rows[-1])):
        for d, slot in enumerate(path):
            keys[slot] = hashlib.md5(row["key"] + row["path"][: SYMBOL * d]).digest() if d else row["key"]
            above[slot] = [keys[x] for x in path[: d + 1]]
    named = {r["key"]: r["root_conv"] for r in rows if r["root_conv"] is not None}
    for row, slot in zip(rows, trie.step(np.zeros(len(rows), np.int64), codes[:, 0]).tolist(), strict=True):
        conv[slot] = named.get(row["key"], conv[slot])
        keys[slot] = row["key"]
    children += below
    for found in reversed(slots):
        done = found[~open_[found]]
        leaves[done] += (children[done] == 0) & (passing[done] == 0)
        saved[done] += (n[done] - 1) * width[done]
        up = trie.check[found]
        np.add.at(leaves, up, leaves[found])
        np.add.at(saved, up, saved[found])
        np.add.at(children, trie.check[done], 1)
    found = np.concatenate(slots)
    up = trie.check[found]
    hang = (depth[found] > 0) & open_[up]
    inner = (depth[found] > 0) & ~open_[up]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(open_[found]),
            pa.array(depth[found] == 0),
            pa.array([keys.get(s) for s in found.tolist()], pa.binary()),
            pa.array([keys[u] if x else None for u, x in zip(up.tolist(), hang.tolist(), strict=True)], pa.binary()),
            pa.array(conv[found]),
            pa.array(depth[found] + SEGMENT * level[found]),
            pa.array(conv[up], mask=~inner),
            *(pa.array(x[found]) for x in (n, children, leaves, saved)),
            pa.array(ends[found].tolist(), pa.string()),
            pa.array(width[found]),
            pa.array(passing[found]),
            pa.array([above.get(s) for s in found.tolist()], pa.list_(pa.binary())),
        ],
        names=[x.split(" ")[0] for x in _NODES.split(", ")],
    )


def _shards(run_symbols: int):
    def run(batches):
        rows, size = [], 0
        for batch in batches:
            for row in batch.to_pylist():
                rows.append(row)
                size += 1 + len(row["path"]) // SYMBOL
                if size >= run_symbols:
                    yield _shard(rows)
                    rows, size = [], 0
        if rows:
            yield _shard(rows)

    return run


# --- nodes ------------------------------------------------------------------------------------


def _nodes(segs: DataFrame, run_symbols: int) -> DataFrame:
    """All nodes of distinct segments, the roots of segments among them, with totals of what lies in and below."""
    order = "key", "path"
    shards = segs.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_shards(run_symbols), _NODES)
    shards = cut(shards)
    sums = [F.sum(x).alias(x) for x in ("n_convs", "n_children", "n_leaves", "saved_tokens", "passing")]
    most = [F.max(x).alias(x) for x in ("up", "depth", "size", "root", "above")]
    ends = F.coalesce(F.max(F.when(F.col("ends_sha256") != _NONE, F.col("ends_sha256"))), F.lit(_NONE)).alias("ends_sha256")
    open_ = cut(shards.filter("open").groupBy("key").agg(F.min("conv_id").alias("conv_id"), *sums, *most, ends))
    kids = open_.filter("up is not null").groupBy(F.col("up").alias("key")).agg(F.count("*").alias("_kids"))
    open_ = open_.join(kids, "key", "left").withColumn("n_children", F.col("n_children") + F.coalesce("_kids", F.lit(0)))
    childless = ((F.col("n_children") == 0) & (F.col("passing") == 0)).cast("long")
    gain = (F.col("n_convs") - 1) * F.col("size")
    own = open_.select(F.explode("above").alias("key"), childless.alias("_leaves"), gain.alias("_saved"))
    own = own.groupBy("key").agg(F.sum("_leaves").alias("_leaves"), F.sum("_saved").alias("_saved"))
    names = open_.select(F.col("key").alias("up"), F.col("conv_id").alias("_parent"))
    merged = open_.join(own, "key").join(names, "up", "left")
    merged = merged.select(
        "root", "key", "conv_id", "depth", F.col("_parent").alias("parent_conv_id"), "n_convs", "n_children",
        (F.col("n_leaves") + F.col("_leaves")).alias("n_leaves"), (F.col("saved_tokens") + F.col("_saved")).alias("saved_tokens"), "ends_sha256",
    )
    complete = shards.filter("not open")
    hanging = complete.filter("up is not null").join(broadcast_if_small(names, KEY_BYTES), "up")
    hanging = hanging.withColumn("parent_conv_id", F.col("_parent"))
    return merged.union(complete.filter("up is null").select(merged.columns)).union(hanging.select(merged.columns))


def _totals(segs: DataFrame, ups: DataFrame, run_symbols: int) -> DataFrame:
    """Of each segment root: (end, b_children, b_leaves, b_saved) of all that lies below it, over all levels.

    ``ups`` names the root above each root.  Totals reach 2^k levels up after k rounds.
    """
    roots = _nodes(segs, run_symbols).filter("root").select("key", "n_children", "n_leaves", "saved_tokens")
    at = cut(roots.join(ups, "key", "left"))
    while at.filter("up is not null").limit(1).count():
        gains = at.filter("up is not null").groupBy(F.col("up").alias("key"))
        gains = gains.agg(F.sum("n_leaves").alias("_l"), F.sum("saved_tokens").alias("_s"))
        far = at.select(F.col("key").alias("up"), F.col("up").alias("_up"))
        at = at.join(gains, "key", "left").join(far, "up", "left")
        at = cut(
            at.select(
                "key", "n_children", (F.col("n_leaves") + F.coalesce("_l", F.lit(0))).alias("n_leaves"),
                (F.col("saved_tokens") + F.coalesce("_s", F.lit(0))).alias("saved_tokens"), F.col("_up").alias("up"),
            )
        )
    names = [F.col(x).alias(y) for x, y in (("key", "end"), ("n_children", "b_children"), ("n_leaves", "b_leaves"), ("saved_tokens", "b_saved"))]
    return at.select(*names)


def nodes(conversations: DataFrame, run_symbols: int = RUN_SYMBOLS) -> DataFrame:
    """One row per distinct prefix of the rebuilt conversations, from the root without turns down.

    ``conversations`` has conv_id, turn, role and text; other columns are not read.  Rows without a
    conv_id belong to no conversation and take no part.  Turns of equal number (or none, first) follow by role, then
    text; a repeated row is a turn of its own; null roles and texts are empty; a very long text is
    known by its digest.  No conversations have no nodes.

    Returns conv_id (smallest member), depth, parent_conv_id (null for the root), n_convs, n_children,
    n_leaves, saved_tokens and ends_sha256.
    """
    parts = segments(conversations)
    counted = parts.groupBy("level", "key", "path", "end").agg(
        F.count("*").alias("n"), F.min("conv_id").alias("conv_id"), F.sum(F.col("more").cast("long")).alias("passing")
    )
    segs = cut(counted.join(id_digests(parts.filter("not more").select("end", "conv_id")), "end", "left"))
    nothing = {x: F.lit(None).cast("long") for x in ("root_conv", "b_children", "b_leaves", "b_saved")}
    if not segs.filter("level > 0").limit(1).count():
        return _nodes(segs.withColumns(nothing), run_symbols).select(COLUMNS)
    through = segs.filter("passing > 0").select(F.col("end").alias("key"), F.col("key").alias("up"), F.col("conv_id").alias("root_conv"), "level")
    lower = segs.filter("level > 0")
    ups = through.select("key", F.when(F.col("level") > 0, F.col("up")).alias("up"))
    below = _totals(lower.withColumns(nothing), ups, run_symbols)
    named = lower.join(through.select("key", "root_conv"), "key").unionByName(
        segs.filter("level = 0").withColumn("root_conv", nothing["root_conv"])
    )
    found = _nodes(named.join(below, "end", "left"), run_symbols)
    return found.filter("not root or depth = 0").select(COLUMNS)
