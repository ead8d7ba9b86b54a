"""Two tokenizers aligned, against plain loops over every token pair."""

import bisect
import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from stationlab.llm import alignment
from stationlab.llm.queries import ALIGNED

FILES = tuple(map(public_tokenizers.path, ALIGNED))
COLUMNS = "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256".split()


@pytest.mark.parametrize("piece", [1, 2, 5, 1 << 14])
def test_merge_pieces_equal_all_pairs(piece):
    rng = random.Random(piece)
    for _ in range(60):
        total = rng.randrange(1, 60)
        a, b = (np.array(sorted({total, *rng.sample(range(1, total + 1), rng.randrange(total))})) for _ in "ab")
        i, j, ties_a, ties_b = alignment.merge(a, b, piece)
        starts = [np.append(0, x[:-1]) for x in (a, b)]
        pairs = [(x, y) for x in range(len(a)) for y in range(len(b)) if starts[0][x] < b[y] and starts[1][y] < a[x]]
        assert sorted(zip(i.tolist(), j.tolist())) == pairs
        assert a[ties_a].tolist() == b[ties_b].tolist() == sorted(set(a.tolist()) & set(b.tolist()))


def by_hand(rows):
    """(doc_id, text) rows aligned whole, one token pair after the other."""
    pair = alignment.Pair(*FILES)
    made, linked = [], []
    for doc, text in rows:
        ids = spelt = None
        if text:
            ids = pair.a.encode(" " + text, add_special_tokens=False).ids, pair.b.encode(text)
            spelt = [b"".join(t[i] for i in x) for t, x in zip((pair.bytes_a, pair.bytes_b), ids)]
        if not text or set(spelt) != {(" " + text).encode()}:
            made.append([doc, 0, 0, 0, ""])
            linked.append(Counter())
            continue
        ends = [np.cumsum([len(t[i]) for i in x]).tolist() for t, x in zip((pair.bytes_a, pair.bytes_b), ids)]
        shared = sorted(set(ends[0]) & set(ends[1]))
        at = [[bisect.bisect_right(es, e) for e in [0, *shared]] for es in ends]
        groups = [
            "|".join(",".join(map(str, x[cut[g] : cut[g + 1]])) for x, cut in zip(ids, at)) for g in range(len(shared))
        ]
        links, i, j = Counter(), 0, 0
        while i < len(ids[0]):
            links[ids[0][i], ids[1][j]] += 1
            a, b = ends[0][i], ends[1][j]
            i, j = i + (a <= b), j + (b <= a)
        made.append([doc, len(ids[0]), len(ids[1]), len(groups), hashlib.sha256(";".join(groups).encode()).hexdigest()])
        linked.append(links)
    held = Counter(x for links in linked for x in links)
    most = Counter()
    for (a, _), n in held.items():
        most[a] = max(most[a], n)
    out = []
    for (doc, n_a, n_b, n_groups, digest), links in zip(made, linked):
        best = sum(n for (a, b), n in links.items() if held[a, b] == most[a])
        out.append((doc, n_a, n_b, n_groups, sum(links.values()), best, sum(n * held[x] for x, n in links.items()), digest))
    return Counter(out), held, most


ODD = [
    "a  b c", " lead x", "tail \n", "x ▁ y", "▁", "a\x00b <|endoftext|> <s> c</s>", "日本 ﬁ é éx 👩‍👧",
    "  a b  c d", "​ x", "tab\t y\n\n z", "\x1c a \x1d b", "don't we'll 12 345,678", "  x　 y", " ",
]


def test_alignment_equals_brute_force(odd, odd_rows, make):
    rows = [(d, t) for d, t, _ in odd_rows] + [(1000 + i, t) for i, t in enumerate(ODD)] + [(1003, ODD[3])]
    docs = odd.unionByName(make([(d, t, "s1") for d, t in rows[len(odd_rows) :]]))
    found, links = alignment.align(docs, *FILES, block_links=3000)
    expected, held, most = by_hand(rows)
    assert Counter(tuple(r[c] for c in COLUMNS) for r in found.collect()) == expected
    assert {(r.a_id, r.b_id): (r.n_docs, r.best) for r in links.collect()} == {
        x: (n, n == most[x[0]]) for x, n in held.items()
    }


def test_alignment_of_nothing(none, make):
    assert [d.count() for d in alignment.align(none, *FILES)] == [0, 0]
    rows = alignment.align(make([(1, None, "s"), (1, "", "s"), (None, None, "s")]), *FILES)[0].collect()
    assert sorted(map(tuple, rows), key=str) == sorted([(d, 0, 0, 0, 0, 0, 0, "") for d in (1, 1, None)], key=str)


def test_memory_of_stretches_is_bounded():
    pair = alignment.Pair(*FILES, memo_bytes=20_000)
    whole = alignment.Pair(*FILES)
    rng = random.Random(5)
    for _ in range(5):
        some = [" ".join(f"w{rng.randrange(2000)}" for _ in range(100)) for _ in range(5)]
        for x, y in zip(pair(some), whole(some), strict=True):
            assert [k.tolist() for k in x] == [k.tolist() for k in y]
    assert len(pair.memo) < len(whole.memo)
