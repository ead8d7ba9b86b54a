"""Personal data: patterns against plain regular expressions, the field against sums over all tag sequences."""

import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest

from stationlab.llm import private_spans as ps

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def by_hand(text):
    found = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m[0] if c in "0123456789"]
            total = sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(reversed(digits)))
            good = {
                "email": True,
                "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")),
                "card": 16 <= len(digits) <= 19 and total % 10 == 0,
                "phone": 8 <= len(digits) <= 15,
            }
            if good[kind]:
                found.append((kind, *m.span()))
    return found


ODD = [
    "a@b.c_d@e.f a@b@c.d .@-.- x@y.", "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.0004 0.1.2.3.4", "4111 1111-1111 1111 4111 1111 1111 1112",
    "+1 (555) 555-0134... +1 2 ++12345678 +123456789012345678 +1((((", "é@x.y a@é.b ab@cd.éf 👩a@b.co", "4" * 40 + " 1" * 30, "a" * 300 + "@x.y",
]


def test_patterns_equal_plain_expressions():
    rng = random.Random(1)
    noise = ["".join(rng.choice("ab1.2@+- ()é9\n") for _ in range(rng.randrange(60))) for _ in range(3000)]
    for text in ODD + noise:
        assert ps.patterns(text) == by_hand(text), text


def test_words_equal_plain_splitting():
    rng = random.Random(2)
    for text in ODD + ["".join(rng.choice("ab1.\n#+é \t(") for _ in range(rng.randrange(40))) for _ in range(500)]:
        low, high, line, features = ps.words(text)
        found = []
        for m in re.finditer(r"[^\x20\x09-\x0D]+", text):
            first = [i for i, c in enumerate(m[0]) if re.match(r"[A-Za-z0-9+(\[]|[^\x00-\x7f]", c)]
            last = [i for i, c in enumerate(m[0]) if re.match(r"[A-Za-z0-9)\]]|[^\x00-\x7f]", c)]
            whole = bool(first and last and first[0] <= last[-1])
            found.append((m.start() + first[0], m.start() + last[-1] + 1) if whole else (m.start(), m.start()))
        assert list(zip(low.tolist(), high.tolist())) == found
        assert line.tolist() == [text[: m.start()].count("\n") for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
    same = ps.words("(555) +1-22 ab.12 Ab.19")[3]
    assert same[0, 0] != same[1, 0] and ps.words("xy 555 ab.12")[3][2, 0] == ps.words("cd.34")[3][0, 0]


def small(seed, lengths):
    rng = np.random.default_rng(seed)
    features = rng.integers(0, ps._PAD, (sum(lengths), len(ps._SIZES)))
    weights = rng.normal(0, 0.5, (2 * ps.REACH + 1, ps._PAD + 1, ps.TAGS))
    moves = rng.normal(0, 1, (ps.TAGS + 1, ps.TAGS))
    size = np.array(lengths)
    return features, weights, moves, np.cumsum(size) - size, size


def paths(score, moves):
    """All tag sequences of one chain with their scores."""
    ok = ps._allowed()
    for tags in itertools.product(range(ps.TAGS), repeat=len(score)):
        pairs = list(zip((ps.TAGS, *tags), tags))
        if all(ok[p] for p in pairs):
            yield tags, sum(score[t, k] for t, k in enumerate(tags)) + sum(moves[p] for p in pairs)


def test_viterbi_and_likelihood_equal_all_sequences():
    features, weights, moves, start, size = small(3, [3, 1, 4, 2])
    chain = np.repeat(np.arange(4), size)
    field = ps.Field(weights, moves)
    score = field.scores(features, chain)
    around = ps._around(features, chain)
    plain = sum(weights[k][around[:, k]].sum(1) for k in range(2 * ps.REACH + 1))
    assert np.allclose(score, plain, atol=1e-4)
    best, total, truth = [], 0.0, []
    for s, n in zip(start, size):
        all_of = list(paths(plain[s : s + n], moves))
        best += max(all_of, key=lambda x: x[1])[0]
        own = all_of[len(all_of) // 3]
        truth += own[0]
        total += own[1] - np.log(sum(np.exp(x) for _, x in all_of))
    assert field.decode(score, start, size).tolist() == best
    found = ps.likelihood(weights, moves, around, np.array(truth), start, size)
    assert np.isclose(found[0], total)
    for x, slope, at in ((weights, found[1], (2, features[0, 1], 0)), (weights, found[1], (1, features[0, 2], 3)), (moves, found[2], (0, 1)), (moves, found[2], (ps.TAGS, 0)), (moves, found[2], (1, 2))):
        values = []
        for step in (1e-5, -1e-5):
            x[at] += step
            values.append(ps.likelihood(weights, moves, around, np.array(truth), start, size)[0])
            x[at] -= step
        assert np.isclose((values[0] - values[1]) / 2e-5, slope[at], atol=1e-5)


@pytest.fixture(scope="module")
def learnt(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    return ps.fit(ps.labelled(docs.filter("doc_id % 5 <> 1")))


def test_field_finds_forms_it_was_not_shown(learnt):
    rows = ps.written(seed=99)  # other digits, letters and neighbours than in the table
    found = ps.added([t for t, _ in rows], learnt, [[] for _ in rows])
    hits = Counter()
    for (text, spans), more in zip(rows, found):
        hits["want"] += len(spans)
        hits["right"] += len(set(spans) & set(more))
        hits["made"] += len(more)
    assert hits["right"] >= 0.85 * hits["want"] and hits["right"] >= 0.9 * hits["made"], hits


def test_field_alone_on_held_out_documents(spark, learnt):
    docs = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").filter("doc_id % 5 = 1").collect()]
    base = [ps.patterns(t) for t in docs]
    alone = ps.added(docs, learnt, [[] for _ in docs])
    spans = {(i, *s) for i, b in enumerate(base) for s in b}
    hit = sum(any(k == s[1] and a < s[3] and b > s[2] for k, a, b in alone[s[0]]) for s in spans)
    assert len(spans) > 20 and hit >= 0.85 * len(spans), (hit, len(spans))
    clean = [i for i, b in enumerate(base) if not b]
    assert sum(bool(alone[i]) for i in clean) <= 0.02 * len(clean)


def test_long_lines_are_decoded_alike_in_pieces(learnt, monkeypatch):
    rng = random.Random(4)
    text = " ".join(rng.choice(["ab", "cdé", "(555) 555-0134", "12.03.2024", "555-555-0134"]) for _ in range(900))
    whole = ps.added([text, "", "tail"], learnt, [[], [], []])
    monkeypatch.setattr(ps, "PIECE_WORDS", 10**6)
    assert whole == ps.added([text, "", "tail"], learnt, [[], [], []]) and whole[0]


def test_spans_of_documents(spark, odd, odd_rows, none, learnt):
    odd2 = [(i, t) for i, t in enumerate(ODD)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in odd2], "doc_id long, text string, spans int").repartition(2)
    rows = {r.doc_id: r for r in ps.spans(docs, learnt).collect()}
    for i, text in odd2:
        base = by_hand(text)
        joined = lambda some: ",".join(f"{k}:{a}:{b}" for k, a, b in some)
        r = rows[i]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(b[0] == k for b in base) for k in ps.KINDS]
        assert r.base_sha256 == hashlib.sha256(joined(base).encode()).hexdigest()
        all_of = [(x.split(":")[0], *map(int, x.split(":")[1:])) for x in r.spans.split(",") if x]
        assert set(base) <= set(all_of) and len(all_of) == len(base) + r.n_added
        assert all_of == sorted(all_of, key=lambda x: (ps.KINDS.index(x[0]), x[1]))
    found = ps.spans(odd, learnt).collect()
    assert Counter(r.doc_id for r in found) == Counter(d for d, _, _ in odd_rows)
    assert ps.spans(none, learnt).count() == 0
    assert {tuple(r)[1:] for r in found if r.doc_id in (200, 201)} == {(0, 0, 0, 0, hashlib.sha256(b"").hexdigest(), "", 0)}


def test_field_of_no_rows_adds_nothing(none):
    assert ps.added(["call (555) 555-0134 now"], ps.train([]), [[]]) == [[]]
    assert isinstance(ps.fit(ps.labelled(none)), ps.Field)
