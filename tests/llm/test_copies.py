"""SimHash groups, suffix dedup and components against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import xxhash

from stationlab.llm import simhash, suffix_dedup
from stationlab.llm.common import components


def union(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def plain_fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    grams = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_near_copies_equal_brute_force(odd, odd_rows):
    got = Counter(tuple(r) for r in simhash.near_copies(odd).collect())
    prints = [plain_fingerprint(t) for _, t, _ in odd_rows]
    n = len(prints)
    group = union(n, [(i, j) for i in range(n) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2])
    least = {}
    for (d, _, _), g in zip(odd_rows, group, strict=True):
        if d is not None:
            least[g] = min(least.get(g, d), d)
    expected = Counter((d, f"{p:016x}", least.get(g)) for (d, _, _), p, g in zip(odd_rows, prints, group, strict=True))
    assert got == expected


@pytest.mark.parametrize("max_bits", [1, 2, 3])
@pytest.mark.parametrize("bucket", [4096, 2])
def test_links_connect_all_pairs_within_the_distance(spark, max_bits, bucket):
    rng = random.Random(max_bits)
    seeds = [rng.getrandbits(64) for _ in range(12)]
    prints = set(seeds)
    for s in seeds:
        for _ in range(12):
            x = s
            for _ in range(rng.randrange(1, 5)):
                x ^= 1 << rng.randrange(64)
            prints.add(x)
    prints = sorted(prints)
    rows = spark.createDataFrame([(int(np.array(p, np.uint64).view(np.int64)),) for p in prints], "fp long")
    found = simhash.links(rows, max_bits, bucket).collect()
    at = {int(np.array(p, np.uint64).view(np.int64)): i for i, p in enumerate(prints)}
    pairs = [(at[r.a], at[r.b]) for r in found]
    assert all((prints[a] ^ prints[b]).bit_count() <= max_bits for a, b in pairs)
    n = len(prints)
    every = [(i, j) for i in range(n) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= max_bits]
    assert union(n, pairs) == union(n, every)


def test_components(spark):
    rng = random.Random(1)
    pairs = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)]
    pairs += [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)] + [(7, 7), (None, 3)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(pairs, "a long, b long")).collect())
    real = [(a, b) for a, b in pairs if a is not None and a != b]
    group = union(300, real)
    assert got == {x: group[x] for x in {x for p in real for x in p}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_removal(texts, span=200):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + span] for b in raw for i in range(len(b) - span + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - span + 1):
            if seen[b[i : i + span]] > 1:
                gone[i : i + span] = True
        kept = bytes(x for x, g in zip(b, gone, strict=False) if not g)
        runs = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out.append((len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def passages(seed):
    """Texts that share passages of about 200 bytes in all kinds of ways."""
    rng = random.Random(seed)
    letters = lambda n: "".join(rng.choice("abé ") for _ in range(n))
    shared = [letters(n) for n in (130, 150, 199, 200, 201, 260, 420)]
    rows = []
    for i in range(60):
        parts = [letters(rng.randrange(0, 90))]
        for _ in range(rng.randrange(0, 3)):
            parts += [rng.choice(shared), letters(rng.randrange(0, 40))]
        rows.append((i, "".join(parts), "s"))
    loop = letters(30) * 20
    return rows + [(90, loop, "s"), (91, shared[3] + shared[3], "s"), (92, "z" * 500, "s"), (93, "\0" * 450, "s"), (94, letters(100) + "\0" * 150, "s")]


@pytest.mark.parametrize("block_bytes", [1 << 20, 2000])
def test_suffix_dedup_equals_brute_force(make, odd_rows, block_bytes):
    rows = passages(2) + odd_rows
    got = Counter(tuple(r) for r in suffix_dedup.digests(make(rows).repartition(4), block_bytes).collect())
    assert got == Counter((d, *x) for (d, _, _), x in zip(rows, plain_removal([t for _, t, _ in rows]), strict=True))


def test_crowded_kgrams_are_sorted_in_portions(monkeypatch):
    rng = random.Random(4)
    letters = lambda n: "".join(rng.choice("abcd") for _ in range(n))
    gram, sides = letters(60), [letters(150) for _ in range(4)]
    texts = [letters(rng.randrange(40, 120)) + rng.choice(sides)[rng.randrange(150) :] + gram + rng.choice(sides)[: rng.randrange(150)] + letters(90) for _ in range(150)]
    raw = [t.encode() for t in texts + texts[:5]]
    seen = Counter(b[i : i + 200] for b in raw for i in range(len(b) - 199))
    pieces: dict[tuple[bytes, int], int] = Counter()
    for b in raw:
        first, windows, hashes = suffix_dedup.segments(np.frombuffer(b, np.uint8), np.array([len(b)]))
        pieces.update((b[f : f + n + 199], int(h)) for f, n, h in zip(first.tolist(), windows.tolist(), hashes, strict=True))
    strings, grams = [x for x, _ in pieces], np.array([h for _, h in pieces], np.uint64)
    expected = [[seen[x[i : i + 200]] > 1 for i in range(len(x) - 199)] for x in strings]
    sizes, plain = [], suffix_dedup.Collection.__init__
    monkeypatch.setattr(suffix_dedup.Collection, "__init__", lambda self, data, lengths: (sizes.append(len(data)), plain(self, data, lengths))[1])
    for limit in (400, 3000, 1 << 20):
        sizes.clear()
        found = suffix_dedup.repeats(strings, np.array(list(pieces.values())), grams, limit)
        assert [x.tolist() for x in found] == expected
        assert max(sizes) <= 2 * limit
    assert 0 < sum(map(sum, expected)) < sum(map(len, expected))


def test_buckets_grow_with_the_text(make, monkeypatch):
    rows = passages(3)
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", 200)
    got = suffix_dedup.digests(make(rows)).collect()
    assert Counter(tuple(r) for r in got) == Counter((d, *x) for (d, _, _), x in zip(rows, plain_removal([t for _, t, _ in rows]), strict=True))


def test_collection_is_sorted_by_symbols_and_tails():
    rng = random.Random(4)
    base = bytes(rng.choice(b"ab") for _ in range(300))
    strings = [base, base[20:] + b"b" * 40, base[:230]]
    c = suffix_dedup.Collection(np.frombuffer(b"".join(strings), np.uint8), np.array(list(map(len, strings))))

    def chain(at):
        out = []
        while c.symbols[at]:
            out.append(int(c.symbols[at]))
            at += 1
        return out

    chains = [chain(int(at)) for at in c.at]
    assert chains == sorted(chains) and len(chains) == sum(map(len, strings))
    for i in range(1, len(chains)):
        same = 0
        while same < min(len(chains[i]), len(chains[i - 1])) and chains[i][same] == chains[i - 1][same]:
            same += 1
        assert c.shared[i] == min(suffix_dedup.SPAN, same * suffix_dedup.SYMBOL)
    assert list(c.transform()) == [c.symbols[a - 1] if a else 0 for a in c.at.astype(int)]


def test_a_collection_hashes_little_more_than_its_bytes(monkeypatch):
    rng = random.Random(6)
    strings = [rng.randbytes(rng.randrange(200, 240)) for _ in range(50)]
    data, lengths, sizes, plain = b"".join(strings), np.array(list(map(len, strings))), [], suffix_dedup.hashed
    monkeypatch.setattr(suffix_dedup, "hashed", lambda x, span: (sizes.append(len(x)), plain(x, span))[1])
    suffix_dedup.Collection(np.frombuffer(data, np.uint8), lengths)
    assert len(data) <= sum(sizes) < 1.5 * len(data)


def test_tiles_meet_without_a_seam(monkeypatch):
    x = np.frombuffer(random.Random(7).randbytes(900), np.uint8)
    lengths = np.array([0, 199, 200, 0, 401, 100])
    whole = [suffix_dedup.hashed(x, 24), *suffix_dedup.segments(x, lengths)]
    monkeypatch.setattr(suffix_dedup, "TILE", 7)
    assert all(np.array_equal(a, b) for a, b in zip(whole, [suffix_dedup.hashed(x, 24), *suffix_dedup.segments(x, lengths)], strict=True))
    for width in (1, 2, 24, 177):
        assert suffix_dedup.sliding_least(whole[0], width).tolist() == [whole[0][i : i + width].min() for i in range(len(whole[0]) - width + 1)]


def test_no_rows(none):
    assert simhash.near_copies(none).count() == 0
    assert suffix_dedup.digests(none).count() == 0
