"""Toxicity, quality and the language model: held-out figures, exact counts, defined edge cases."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from stationlab.llm import pitman_yor, quality, toxicity
from tests.llm.conftest import words

BAD = ["grobian", "scoundrel", "wretched", "vermin"]


def toxic_rows(seed, n, spoil=lambda w, rng: w):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        text = words(rng, 40).split()
        bad = i % 4 == 0
        if bad:
            for _ in range(3):
                text.insert(rng.randrange(len(text)), spoil(rng.choice(BAD), rng))
        rows.append((" ".join(text), int(bad)))
    return rows


def test_toxicity_knows_misspellings_of_words_it_learnt():
    model = toxicity.train(toxic_rows(1, 600))
    twist = lambda w, rng: w + rng.choice(["s", "zz", "!"]) if rng.random() < 0.5 else w[:-1] + "xx"
    rows = toxic_rows(2, 300, twist)
    found = np.array(list(model.scores([t for t, _ in rows])))
    labels = np.array([y for _, y in rows])
    order = np.argsort(found)
    ranks = np.empty(len(order))
    ranks[order] = np.arange(len(order))
    bad = labels.sum()
    assert (ranks[labels == 1].sum() - bad * (bad - 1) / 2) / (bad * (len(labels) - bad)) > 0.95


def test_toxicity_is_a_softmax_over_the_mean_of_subword_means():
    model = toxicity.train(toxic_rows(3, 200))
    text = "w1x Grobian! w2x"
    buckets = [toxicity.subwords([w])[0] for w in ("w1x", "grobian", "w2x")]
    logit = model.bias + np.mean([model.weights[b].mean() for b in buckets])
    assert next(model.scores([text])) == pytest.approx(1 / (1 + np.exp(-logit)))


def test_toxicity_edges(spark, odd, odd_rows, none):
    labels = spark.createDataFrame([(0, 1), (1, 0), (1, 1), (None, 1), (2, None), (200, 0)], "doc_id long, toxic int")
    model = toxicity.fit(odd, labels)
    got = toxicity.score(odd, model).collect()
    assert len(got) == len(odd_rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    blank = [r.score for r in got if r.doc_id in (200, 201, 202)]
    assert len(set(blank)) == 1
    assert toxicity.score(none, toxicity.fit(none, labels.limit(0))).count() == 0
    assert toxicity.train([]).bias == 0.0


def test_quality(spark, make, none):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(400):
        bad = (i % 10 < (8 if i < 60 else 1))
        text = " ".join("@@## $$%%" if bad and rng.random() < 0.7 else words(rng, 1) for _ in range(30))
        rows.append((i, text, "bad.example" if i < 60 else "good.example" if i < 398 else "rare.example"))
        labels.append((i, int(not bad)))
    labels = spark.createDataFrame(labels, "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.score(make(rows), labels, F.col("source"), F.concat_ws("/", "source", "lang")).collect()}
    assert len(got) == 400
    truth = [int(x.quality) for x in labels.orderBy("doc_id").collect()]
    assert np.mean([got[i].keep == bool(truth[i]) for i in range(400)]) > 0.97
    assert got[0].host_posterior < got[399].host_posterior < got[100].host_posterior + 0.05
    mean = np.mean([r.evidence for r in got.values()])
    # The sparse site lies between its own share and the global one.
    assert min(mean, 1.0) - 0.02 <= got[399].host_posterior <= 1.0
    assert quality.score(none, labels, F.col("source"), F.col("lang")).count() == 0


def plain_strength(groups, mean):
    """Moments written out: groups are (n, k, s, parent's n, parent's k, parent)."""
    n, m, parents = sum(g[0] for g in groups), len(groups), len({g[5] for g in groups})
    squares = sum(g[0] ** 2 / g[3] for g in groups)
    if n <= m or m <= parents or n <= squares:
        return 1e6
    between = sum(g[0] * (g[1] / g[0] - g[4] / g[3]) ** 2 for g in groups)
    chance = sum(g[2] - g[1] ** 2 / g[0] for g in groups) / (n - m)
    own = (between - (m - parents) * chance) / (n - squares)
    return min(max(mean * (1 - mean) / own - 1, 1.0), 1e6) if own > 0 else 1e6


def test_posteriors_equal_plain_sums(spark):
    """Both levels recomputed row by row from the evidence, with null, sparse, tied and repeated sites."""
    rng = random.Random(21)
    hosts = [(f"h{i}", rng.random()) for i in range(12)] + [(None, 0.5)]
    rows, labels = [], []
    for d in range(600):
        host, good = rng.choice(hosts)
        path = rng.choice([None, "a", "b", "c", f"p{d}"])
        fine = rng.random() < good
        text = " ".join(rng.choice(["tree", "house", "river"] if fine else ["$$$!!!", "x", "7777"]) for _ in range(rng.randrange(1, 40)))
        rows.append((d, text, host, path))
        if d % 3 == 0:
            labels.append((d, int(fine)))
    rows += [rows[5]] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    found = quality.score(docs, spark.createDataFrame(labels, "doc_id long, quality int"), F.col("source"), F.col("lang")).collect()
    per_host, per_path = {}, {}
    for r in found:
        for table, key in ((per_host, r.host), (per_path, (r.host, r.path))):
            n, k, s = table.get(key, (0, 0.0, 0.0))
            table[key] = n + 1, k + r.evidence, s + r.evidence**2
    total = len(found), sum(r.evidence for r in found)
    mean = total[1] / total[0]
    of_hosts = plain_strength([(*v, *total, 0) for v in per_host.values()], mean)
    of_paths = plain_strength([(*v, *per_host[h][:2], h) for (h, _), v in per_path.items()], mean)
    odds = lambda p: np.log(p / (1 - p))
    for r in found:
        (hn, hk, _), (pn, pk, _) = per_host[r.host], per_path[r.host, r.path]
        host = (hk - r.evidence + of_hosts * mean) / (hn - 1 + of_hosts)
        path = (pk - r.evidence + of_paths * host) / (pn - 1 + of_paths)
        assert r.host_posterior == pytest.approx(host, rel=1e-9) and r.path_posterior == pytest.approx(path, rel=1e-9)
        e = min(max(r.evidence, 1e-6), 1 - 1e-6)
        assert odds(r.posterior) == pytest.approx(odds(e) + odds(path) - odds(mean), rel=1e-6, abs=1e-6)
        assert r.keep == (r.posterior >= quality.KEEP)
    assert of_hosts < 1e6


def test_quality_on_held_out_labels(spark):
    """Fitted to four fifths of the labels, ranked on the rest."""
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    got = quality.score(docs, labels.filter("doc_id % 5 <> 0"), F.col("source"), F.concat_ws("/", "source", "lang"))
    rows = got.join(labels.filter("doc_id % 5 = 0"), "doc_id").select("posterior", "quality").collect()
    good, bad = ([r.posterior for r in rows if r.quality == q] for q in (1, 0))
    auc = np.mean([(np.array(bad) < g).mean() + (np.array(bad) == g).mean() / 2 for g in good])
    assert len(bad) > 50 and auc > 0.97, auc


def test_quality_edges(spark, odd, odd_rows):
    labels = spark.createDataFrame([(0, 1), (1, 0), (None, 1), (2, None)], "doc_id long, quality int")
    got = quality.score(odd, labels, F.col("source"), F.col("lang")).collect()
    assert len(got) == len(odd_rows) and all(0 < r.posterior < 1 for r in got)


def plain_counts(rows):
    tokens = [(t or "").encode().lower().split() + [b"\n"] for _, t, _ in rows]
    train = [zlib.crc32(b"" if d is None else str(d).encode()) % 5 != 1 for d, _, _ in rows]
    return tokens, train, Counter(w for x, k in zip(tokens, train, strict=True) if k for w in x)


def test_pitman_yor_counts_equal_brute_force(odd, odd_rows):
    tokens, train, count = plain_counts(odd_rows)
    n, v = sum(count.values()), len(count)
    expected = Counter(
        (d, not k, len(x), sum(count[w] > 0 for w in x), n, round(sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in x), 6))
        for (d, _, _), x, k in zip(odd_rows, tokens, train, strict=True)
    )
    for block_bytes in (8 << 20, 3000):
        got = pitman_yor.score(odd, block_bytes=block_bytes).collect()
        assert Counter((*r[:5], round(r.base_score, 6)) for r in got) == expected
        assert all(r.score < 0 for r in got)


def test_pitman_yor_beats_the_base_on_held_out_text(make):
    rng = random.Random(8)
    follow = {f"w{i}": [f"w{rng.randrange(60)}" for _ in range(3)] for i in range(60)}
    rows = []
    for i in range(300):
        text = [f"w{rng.randrange(60)}"]
        for _ in range(40):
            text.append(rng.choice(follow[text[-1]]))
        rows.append((i, " ".join(text), "s"))
    got = [r for r in pitman_yor.score(make(rows)).collect() if r.held_out]
    assert got and sum(r.score for r in got) > 0.8 * sum(r.base_score for r in got)
    again = [r for r in pitman_yor.score(make(rows)).collect() if r.held_out]
    assert {(r.doc_id, r.score) for r in got} == {(r.doc_id, r.score) for r in again}


def test_pitman_yor_probabilities_sum_to_one():
    rng = np.random.default_rng(0)
    pairs = np.unique(rng.integers(0, 50, 400) * 65536 + rng.integers(0, 6, 400))
    word, context = pairs >> 16, pairs & 65535
    kept, word = np.unique(word, return_inverse=True)
    count = rng.integers(1, 200, len(pairs))
    b = pitman_yor.Bucket(kept.astype(np.uint64), np.searchsorted(word, np.arange(len(kept))), word, context, count)
    totals = pitman_yor.Totals(np.bincount(context, minlength=6).astype(float), float(len(kept)))
    m = pitman_yor.Model(len(kept), int(count.sum()), np.bincount(context, count, 6), 0.7, 0.5, [totals])
    tables, at_root, root_tables = next(m.sweeps(b, 0, 1))
    assert (tables >= 1).all() and (tables <= count).all() and (root_tables <= at_root).all()
    after = pitman_yor.Totals(np.bincount(context, tables, 6), root_tables.sum())
    parent = m.root(np.r_[at_root, 0.0], np.r_[root_tables, 0.0], after)
    assert parent.sum() == pytest.approx(1.0)
    for u in range(6):
        p = (pitman_yor.STRENGTH + m.discount * after.tables[u]) * parent
        mine = context == u
        p[word[mine]] += count[mine] - m.discount * tables[mine]
        assert p.sum() / (pitman_yor.STRENGTH + m.customers[u]) == pytest.approx(1.0)


def test_pitman_yor_seating_follows_the_restaurant():
    rng = np.random.default_rng(1)
    for customers in (5, 300):
        drawn = pitman_yor.seated(np.full(20_000, customers), np.full(20_000, 2.0), 0.5, rng)
        mean, seats = np.zeros(customers + 1), np.zeros(customers + 1)
        seats[1] = 1.0  # the exact law of the number of tables, customer by customer
        for n in range(1, customers):
            t = np.arange(customers + 1)
            new = 2.0 / (2.0 + n - 0.5 * np.minimum(t, n))
            seats = seats * (1 - new) + np.r_[0, (seats * new)[:-1]]
        mean = (seats * np.arange(customers + 1)).sum()
        assert drawn.mean() == pytest.approx(mean, rel=0.03)


def test_pitman_yor_seats_every_customer_of_a_large_dish():
    customers, lure, discount = 2000, 400.0, 0.5
    drawn = pitman_yor.seated(np.full(8000, customers), np.full(8000, lure), discount, np.random.default_rng(3))
    t, law = np.arange(customers + 1), np.zeros(customers + 1)
    law[1] = 1.0
    for n in range(1, customers):
        new = lure / (lure + n - discount * np.minimum(t, n))
        law = law * (1 - new) + np.r_[0, (law * new)[:-1]]
    mean = (law * t).sum()
    spread = (law * (t - mean) ** 2).sum()
    assert abs(drawn.mean() - mean) < 5 * np.sqrt(spread / len(drawn))
    assert drawn.var() == pytest.approx(spread, rel=0.08)


def test_pitman_yor_buckets_grow_with_the_text(make, monkeypatch):
    rows = [(i, f"a b c{i} d{i % 7} e", "s") for i in range(60)]
    asked, plain = [], pitman_yor._requests
    monkeypatch.setattr(pitman_yor, "_requests", lambda blocks, often, buckets: (asked.append(buckets), plain(blocks, often, buckets))[1])
    before = {r.doc_id: r.n_known for r in pitman_yor.score(make(rows)).collect()}
    monkeypatch.setattr(pitman_yor, "BUCKET_BYTES", 20)
    after = {r.doc_id: r.n_known for r in pitman_yor.score(make(rows)).collect()}
    assert before == after and asked[1] >= 2 * asked[0]


def test_pitman_yor_every_word_is_a_context(make):
    # Words of one ending, each under 1/2000 of the tokens, each with a follower of its own.
    pair = lambda i, j: f"p{i}ab q{j}"
    inside, outside = ([i for i in range(400) if (zlib.crc32(str(i).encode()) % 5 == 1) == out] for out in (False, True))
    rows = [(d, " ".join(pair(i, i) for i in range(k % 60, 3000, 60)), "s") for k, d in enumerate(inside[:180])]
    chosen = range(5, 3000, 100)
    rows += [(outside[0], " ".join(pair(i, i) for i in chosen), "s"), (outside[1], " ".join(pair(i, i + 7) for i in chosen[:-1]), "s")]
    got = {r.doc_id: r for r in pitman_yor.score(make(rows).repartition(3), block_bytes=4000).collect()}
    right, wrong = got[outside[0]], got[outside[1]]
    assert right.train_tokens > 2000 * 3 and right.n_known == right.n_tokens
    assert right.score / right.n_tokens > wrong.score / wrong.n_tokens + 0.5


def test_pitman_yor_score_equals_a_plain_model(make):
    # Every dish has one customer, so that nothing is drawn.
    text, asked = "aab bab ccd dcd e", ["aab bab", "bab bab new aab", "new ccd", "new e e dcd aab", ""]
    inside, outside = ([i for i in range(60) if (zlib.crc32(str(i).encode()) % 5 == 1) == out] for out in (False, True))
    got = {r.doc_id: r.score for r in pitman_yor.score(make([(inside[0], text, "s"), *zip(outside, asked, "sssss")])).collect()}
    d, end = 0.95, "\n"
    kind = lambda w: w if w == end else zlib.crc32(w[-2:].encode()) % 512
    pairs = list(zip([end, *text.split()], [*text.split(), end]))
    root = lambda w: ((1 - d) * any(w == x for _, x in pairs) + (1 + d * 6) / 7) / (1 + 6)

    def level(w, mine, parent):
        return ((1 - d) * (w in mine) + (1 + d * len(mine)) * parent) / (1 + len(mine))

    def plain(u, w):
        shared = level(w, [x for v, x in pairs if kind(v) == kind(u)], root(w))
        return math.log10(level(w, [x for v, x in pairs if v == u], shared))

    for doc_id, x in [(inside[0], text), *zip(outside, asked)]:
        tokens = [*x.split(), end]
        assert got[doc_id] == pytest.approx(sum(map(plain, [end, *tokens], tokens)))


def test_pitman_yor_without_rows_or_training(make, none):
    assert pitman_yor.score(none).count() == 0
    out = [i for i in range(60) if zlib.crc32(str(i).encode()) % 5 == 1]
    got = pitman_yor.score(make([(i, "a b", "s") for i in out])).collect()
    assert len(got) == len(out) and all(r.held_out and r.train_tokens == 0 and r.n_known == 0 and r.score == 0 for r in got)
