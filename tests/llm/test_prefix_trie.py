"""Prefix nodes of rebuilt conversations, against plain dictionaries of whole prefixes."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from stationlab.llm import prefix_trie


def by_hand(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in own.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        rebuilt[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members, kids = defaultdict(list), defaultdict(set)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
            if d:
                kids[turns[: d - 1]].add(turns[:d])
    leaves, saved = Counter(), Counter()
    for node, some in members.items():
        gain = (len(some) - 1) * len(node[-1][1].encode()) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += not kids[node]
            saved[node[:d]] += gain
    return Counter(
        (
            min(some), len(node), min(members[node[:-1]]) if node else None, len(some), len(kids[node]), leaves[node], saved[node],
            hashlib.sha256(",".join(str(c) for c in sorted(some) if len(rebuilt[c]) == len(node)).encode()).hexdigest(),
        )
        for node, some in members.items()
    )


def check(spark, rows, run_symbols):
    schema = "conv_id long, turn long, role string, text string, key int, level int, up int, end int, path int, _head int"
    table = spark.createDataFrame([(*r, 1, 2, 3, 4, 5, 6) for r in rows], schema).repartition(3)
    found = prefix_trie.nodes(table, run_symbols)
    assert Counter(map(tuple, found.collect())) == by_hand(rows)


def talks(rng, convs, longest, words):
    return [
        (c, t, rng.choice(["user", "assistant"]) if rng.random() < 0.2 else ("user", "assistant")[t % 2], f"é{rng.randrange(words)}")
        for c in convs
        for t in range(rng.randrange(1, longest))
    ]


@pytest.mark.parametrize("run_symbols", [40, 1 << 16])
def test_nodes_equal_brute_force(spark, run_symbols):
    rng = random.Random(7)
    rows = talks(rng, range(120), 12, 3)
    # Copies of one conversation, null and repeated turns, null roles and texts, an absent base, no conversation, a negative id.
    rows += [(200 + i, t, "user", "same") for i in range(40) for t in range(5)]
    rows += [(301, None, None, None), (301, None, None, None), (301, 2, "a", "x"), (301, 2, "a", "w"), (301, 2, "a", "w")]
    rows += [(303, 0, None, ""), (None, 0, "user", "lost"), (-7, 0, "user", "é"), (-5, 0, "user", "é" * 50_000)]
    check(spark, rows, run_symbols)


@pytest.mark.parametrize("run_symbols", [100, 1 << 16])
def test_conversations_longer_than_segments(spark, run_symbols):
    rng = random.Random(9)
    trunk = [f"t{i}" for i in range(400)]
    rows = []
    for c in range(30):
        keep, more = rng.randrange(0, 400), rng.choice([0, 1, 64, 130])
        rows += [(c, t, "user", x) for t, x in enumerate(trunk[:keep] + [f"own{rng.randrange(2)}" for _ in range(more)] or ["only"])]
    rows += [(100 + c, t, "user", trunk[t]) for c in range(3) for t in range(128)]
    rows += [(110, t, "user", trunk[t % 400]) for t in range(64)]
    check(spark, rows, run_symbols)


def test_no_conversations(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefix_trie.nodes(empty).count() == 0


def test_double_array_walks_every_path_and_no_other():
    rng = random.Random(2)
    paths = sorted({tuple(rng.randrange(1, 30) for _ in range(rng.randrange(1, 7))) for _ in range(400)})
    size = np.array([len(p) for p in paths])
    codes = np.array([p + (0,) * (6 - len(p)) for p in paths])
    trie = prefix_trie.pack(codes, size)
    nodes = {p[:d] for p in paths for d in range(1, len(p) + 1)}
    slots = set()
    for node in nodes | {n[:-1] + (31,) for n in nodes} | {n + (rng.randrange(1, 31),) for n in nodes}:
        state = np.zeros(1, np.int64)
        for code in node:
            state = trie.step(state, np.array([code])) if state[0] >= 0 else state
        assert (state[0] >= 0) == (node in nodes)
        if node in nodes:
            slots.add(int(state[0]))
    assert len(slots) == len(nodes) and trie.top < 4 * len(nodes)


def test_hash_of_ids_cut_between_rows(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "ID_TEXT", 10)
    pairs = [(b"a", i) for i in range(-3, 300)] + [(b"b", 5)]
    found = prefix_trie.id_digests(spark.createDataFrame(pairs, "end binary, conv_id long").repartition(4)).collect()
    plain = {k: hashlib.sha256(",".join(str(i) for x, i in sorted(pairs) if x == k).encode()).hexdigest() for k in (b"a", b"b")}
    assert {bytes(r.end): r.ends for r in found} == plain
