"""Decontamination, mixing, token files, licences, neighbours and the pipeline."""

import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from stationlab.llm import decontaminate, hilbert_search, licences, mixing, queries, token_files
from tests.llm.conftest import words

WORDS = public_tokenizers.path("word_bpe_49k.json")
SMALL = "/root/testdata/sf0.001"


def items_of(rng, n):
    return [(i, words(rng, 18, 0, 5000) + ". " + words(rng, 6, 0, 5000) + ".") for i in range(n)]


def test_leaks(spark, make, odd_rows):
    rng = random.Random(6)
    items = items_of(rng, 40)
    rows = list(odd_rows)
    expected = set()
    for i, (item, text) in enumerate(items[:20]):
        w = text.split()
        kind = i % 5
        if kind == 1:
            w = [x.upper() if j % 2 else f'"{x}"' for j, x in enumerate(w)]
        if kind == 2:
            w[3], w[9] = "changed", "words"
        if kind == 3:
            w = w[:18] + words(rng, 7, 0, 5000).split()  # the question with another answer
        if kind == 4:
            w = w[18:]  # the answer alone
        rows.append((1000 + i, words(rng, rng.randrange(300), 0, 5000) + " " + " ".join(w) + " " + words(rng, 50, 0, 5000), "s"))
        if kind < 3:
            expected.add((1000 + i, item))
    table = items + [(50, None), (51, ""), (None, items[0][1]), items[1]]
    benchmark = spark.createDataFrame(table, "item_id long, text string").withColumn("doc_id", F.lit(1))
    for shard in (decontaminate.SHARD_BYTES, 1500):
        found = decontaminate.leaks(make(rows).repartition(2), benchmark, shard_bytes=shard).collect()
        assert {(r.doc_id, r.item_id) for r in found} == expected
        assert len(found) == len(expected)


def test_search_equals_scoring_every_item():
    rng = random.Random(7)
    items = [(i, " ".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 12)))) for i in range(60)]
    known = Counter(t for _, x in items for t in set(decontaminate.terms(x)))
    index = decontaminate.Index.build(items, known, len(items), 7.0)
    for _ in range(200):
        query = sorted(rng.sample(range(len(index.vocabulary)), rng.randrange(1, 10)))
        score = Counter()
        for t in query:
            for d, x in zip(index.docs[t], index.impacts[t], strict=True):
                score[d] += x
        for threshold in (0.3, 0.6, 0.9):
            live = index.live_blocks(np.zeros(len(query), np.int64), np.array(query) + 1, 1, threshold)[1]
            got = dict(index.search(query, live, threshold))
            assert set(got) == {d for d, x in score.items() if x >= threshold - 1e-9}
            assert all(got[d] == pytest.approx(score[d]) for d in got)


def test_no_leak_from_scattered_words_whatever_other_items_there_are(spark, make):
    """A long item widens no other item's passages, and words far apart are no match."""
    rng = random.Random(12)
    item = "what is the name of the first man on the moon. neil armstrong."
    long_item = words(rng, 6000, 0, 10**6)
    far = " ".join(w + " " + words(rng, 400, 5000, 9000) for w in item.split())
    wide = " ".join(w + " " + words(rng, 7, 5000, 9000) for w in item.split())
    near = " ".join(w + (" so" if i % 3 == 2 else "") for i, w in enumerate(item.split()))
    inside = words(rng, 333, 5000, 9000) + " "
    rows = [(1, far, "s"), (2, wide, "s"), (3, inside + near, "s"), (4, inside + long_item + " " + inside, "s"), (5, inside * 5 + item, "s")]
    for items in ([(1, item)], [(1, item), (2, long_item)]):
        found = decontaminate.leaks(make(rows), spark.createDataFrame(items, "item_id long, text string")).collect()
        assert {(r.doc_id, r.item_id) for r in found} == {(3, 1), (5, 1)} | ({(4, 2)} if len(items) > 1 else set())


def test_scores_equal_plain_bm25(spark, make):
    """The reported score is BM25 of the passage's distinct words over the item's own, counted from the texts."""
    items = [(i, f"{a} {a} question {b} about {c}. answer {c} {i}") for i, (a, b, c) in enumerate(("xyz", "yzx", "zzy", "abx"))]
    split = {i: decontaminate.terms(t) for i, t in items}
    n, mean = len(items), sum(map(len, split.values())) / len(items)
    found = decontaminate.leaks(make([(9, "the x x question y about z. answer z 0 and more", "s")]), spark.createDataFrame(items, "item_id long, text string")).collect()
    passage = set(decontaminate.terms("the x x question y about z. answer z 0 and more"))
    for r in found:
        own = split[r.item_id]
        weight = {}
        for t in set(own):
            df, tf = sum(t in w for w in split.values()), own.count(t)
            weight[t] = np.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(own) / mean))
        assert r.score == pytest.approx(sum(x for t, x in weight.items() if t in passage) / sum(weight.values()))
    assert [r.item_id for r in found] == [0]


def test_leaks_without_rows(spark, none, odd):
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.leaks(none, empty).count() == 0
    assert decontaminate.leaks(odd, empty).count() == 0


def test_token_files_round_trip(spark, odd, odd_rows, none, tmp_path):
    tokenizer = Tokenizer.from_file(WORDS)
    ids = lambda t: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
    out = str(tmp_path / "files")
    token_files.write(odd, out, WORDS, block_bytes=5000)
    got = token_files.read(spark, out).collect()
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter((d, len(ids(t)), crc(ids(t))) for d, t, _ in odd_rows)
    ahead = 0
    for r in sorted(got, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.start)):
        assert r.start == ahead
        ahead += r.n_tokens
    assert token_files.document(spark, out, 204) == [ids(odd_rows[[d for d, _, _ in odd_rows].index(204)][1])]
    assert token_files.document(spark, out, 206) == [ids("same row")] * 2
    assert token_files.document(spark, out, 999) == []
    token_files.write(none, str(tmp_path / "none"), WORDS)
    assert token_files.read(spark, str(tmp_path / "none")).count() == 0


def test_words_on_their_own_have_the_ids_of_the_whole_text():
    tokenizer, encode = Tokenizer.from_file(WORDS), token_files.Encoder(WORDS)
    rng = random.Random(9)
    parts = ["it's", "IT'S!!", "é.", "É,", "İ", "Σς.", "x,y..", "3.14,", "<|endoftext|>", "<|ENDOFTEXT|>", "a b", "\x1c", "z\x85", "'re", "ﬁ", "KK.", "á.", "日本", "‍", "!?", "—."]
    for _ in range(200):
        text = "".join(rng.choice(parts) + rng.choice([" ", "", "\n", "\t"]) for _ in range(rng.randrange(8)))
        expected = np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        assert next(encode([text.encode()]), b"") == expected, repr(text)


def test_mix(make, odd, odd_rows, none):
    got = mixing.taken(odd).collect()
    sizes = Counter((d, len((t or "").encode().split())) for d, t, _ in odd_rows)
    assert Counter((r.doc_id, r.size) for r in got) == sizes
    assert all(0 <= r.taken <= 2 * r.size for r in got)
    assert sum(r.target for r in {r.source_size: r for r in got if r.target}.values()) > 0
    per, source = {}, {d: x for d, _, x in odd_rows}
    for r in got:
        per.setdefault((source[r.doc_id], r.source_size, r.target), []).append(r.taken)
    total = 1.5 * sum(n for (_, n), k in sizes.items() for _ in range(k))
    block = max(1, min(mixing.BLOCK_WORDS, int(total // mixing.LEAST_SLOTS)))
    for (_, size, target), taken in per.items():
        if size:
            assert abs(sum(taken) - target) <= 4 * block
    assert Counter(map(tuple, got)) == Counter(map(tuple, mixing.taken(odd.repartition(5)).collect()))
    assert mixing.taken(none).count() == 0
    assert mixing.taken(make([(1, None, "a"), (2, " ", None)])).agg(F.sum("taken")).first()[0] == 0


def test_mix_slots_hold_each_block_once(odd):
    rows = [r for r in mixing.spans(odd).collect() if r.slot is not None]
    by_slot = {}
    for r in rows:
        by_slot.setdefault(r.slot, set()).add(r.source)
    assert all(len(x) == 1 for x in by_slot.values())
    assert all(0 <= r.from_word and r.from_word + r.n_words <= r.size for r in rows)


def plain_nearest(rows, k):
    found = []
    for q, x in rows:
        if q % 2 == 0:
            best = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), v) for v, y in rows if v != q)[:k]
            found += [(q, i + 1, v, -s) for i, (s, v) in enumerate(best)]
    return found


def test_neighbours_of_whole_windows_are_exact(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=6).astype(np.float32).astype(float).tolist()) for i in range(120)]
    rows += [(200 + i, [1.0, 0.0, 0.5, 0.0, 0.0, 2.0]) for i in range(30)]
    odd = [(300, None), (302, [0.0] * 6), (304, [None] + [1.0] * 5), (306, [float("nan")] * 6), (308, [float("inf")] * 6), (310, [1.0]), (312, []), (None, [1.0] * 6)]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").withColumn("curve", F.lit(1)).withColumn("v", F.lit(2))
    got = hilbert_search.search(table.repartition(3), "vec_id % 2 = 0", 5, curves=2, window=1.0, block=16).collect()
    expected = plain_nearest(rows, 5)
    assert sorted(r[:3] for r in got) == sorted(r[:3] for r in expected)
    exact = {(q, v): s for q, _, v, s in expected}
    assert all(r.score == pytest.approx(exact[r.query_id, r.vec_id], abs=1e-12) for r in got)


def test_neighbours_with_few_or_no_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    two = spark.createDataFrame([(2, [1.0, 0.0]), (3, [0.5, 1.0])], schema)
    assert [tuple(r) for r in hilbert_search.search(two, "vec_id % 2 = 0").collect()] == [(2, 1, 3, 0.5)]
    assert hilbert_search.search(spark.createDataFrame([], schema), "vec_id % 2 = 0").count() == 0


def test_hilbert_curve_steps_to_neighbours():
    for axes, bits in ((2, 5), (3, 3), (6, 2)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * axes, indexing="ij"), -1).reshape(-1, axes)
        keys = hilbert_search.hilbert_keys(grid, bits)
        assert sorted(keys) == list(range(len(grid)))
        assert (np.abs(np.diff(grid[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


def test_recall_of_the_registered_search(spark):
    got = {(r.query_id, r.vec_id) for r in queries.nearest(spark, "/root/testdata/sf0.01").collect()}
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").toPandas().sort_values("vec_id")
    ids, v = table.vec_id.to_numpy(), np.stack(table.embedding).astype(float)
    ask = ids % 20 == 0
    score = v[ask] @ v.T
    score[ids[ask][:, None] == ids[None, :]] = -np.inf
    best = ids[np.argsort(-score, axis=1, kind="stable")[:, :20]]
    expected = {(q, x) for q, row in zip(ids[ask], best, strict=True) for x in row}
    assert len(got & expected) >= 0.9 * len(expected)


def test_licences(spark, none):
    mit, gpl = licences.TEMPLATES["MIT"], licences.TEMPLATES["GPL-3.0"]
    files = [
        ("r/LICENSE", gpl), ("r/a/x.py", "plain words of a file"), ("r/a/b/LICENSE.txt", mit), ("r/a/b/c/d/y.py", "more words"),
        ("r/a/z.py", f"# top\n# {licences.TEMPLATES['Apache-2.0']}\ncode follows here"), ("other/q.py", "nothing"), ("top.py", None),
        ("r/a/wrapped.py", "Released under\nthe MIT License.\n\ncode"), (None, "no path"), (None, mit), ("r/a/x.py", "plain words of a file"),
        ("r/a/like.py", "This work of mine is about the version of a public house."), ("r/ab/x.py", ""),
    ]
    table = spark.createDataFrame(files, "path string, text string")
    for c in ("licence", "own", "_own", "line", "_directory", "term", "n"):
        table = table.withColumn(c, F.lit(0))
    got = Counter((r.path, r.own, r.licence, r.inherited_from) for r in licences.scan(table.repartition(3)).collect())
    assert got == Counter([
        ("r/LICENSE", "GPL-3.0", "GPL-3.0", None), ("r/a/x.py", None, "GPL-3.0", "r"), ("r/a/x.py", None, "GPL-3.0", "r"),
        ("r/a/b/LICENSE.txt", "MIT", "MIT", None), ("r/a/b/c/d/y.py", None, "MIT", "r/a/b"), ("r/a/z.py", "Apache-2.0", "Apache-2.0", None),
        ("other/q.py", None, None, None), ("top.py", None, None, None), ("r/a/wrapped.py", "MIT", "MIT", None), (None, None, None, None),
        (None, "MIT", "MIT", None), ("r/a/like.py", None, "GPL-3.0", "r"), ("r/ab/x.py", None, "GPL-3.0", "r"),
    ])
    assert licences.scan(table.limit(0)).count() == 0


def test_licence_scan_skips_no_passage_over_the_threshold():
    rng = random.Random(3)
    model = licences.Templates(licences.TEMPLATES, {"the": 900, "to": 900, "and": 900}, 1000, 0.8)
    pool = sorted({t for x in licences.TEMPLATES.values() for t in licences.terms(x)}) + ["alpha", "beta"]
    for _ in range(3000):
        line = " ".join(rng.choice(pool) for _ in range(rng.randrange(1, 9)))
        hit = model.best(line)
        assert (model.scan(line)[0] is not None) == (hit is not None)


def test_pipeline_stages_keep_the_columns(spark, odd, odd_rows, none):
    docs = odd.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, SMALL)
        if name == "token_output":
            assert got.count() == docs.count()
        else:
            assert got.columns == docs.columns
        if name == "simhash":
            kept = Counter(r.doc_id for r in got.collect())
            assert kept[100] == 1 and not any(kept[100 + i] for i in range(1, 6)) and kept[None] == 1
        if name == "mixing":
            times = Counter(r.doc_id for r in got.collect())
            assert max(times[d] for d in times if d != 206) <= 2
    empty = none.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SMALL).count() == 0, name


def test_pipeline_keeps_one_row_of_a_group_of_copies(spark):
    """Exact and near copies under one id, under none, and beside other texts of that id; clashing columns."""
    rng = random.Random(6)
    texts = [words(rng, 80) for _ in range(6)]
    rows = [(1, texts[0], 1), (1, texts[0], 2), (1, texts[0], 1), (None, texts[1], 1), (None, texts[1], 2), (None, texts[2], 1)]
    rows += [(2, texts[3], 1), (3, texts[3], 1), (3, texts[4], 1), (None, texts[3], 1), (4, texts[5], 1), (None, None, 1), (None, "", 3)]
    docs = spark.createDataFrame([(*r, 7, 8, 9) for r in rows], "doc_id long, text string, odd int, key int, id int, times int").repartition(3)
    kept = corpus_pipeline.drop_near_copies(spark, docs, SMALL)
    assert kept.columns == docs.columns
    got = sorted(((r.doc_id, r.text or "", r.odd) for r in kept.collect()), key=str)
    expected = [(1, texts[0], 1), (None, texts[1], 1), (None, texts[2], 1), (2, texts[3], 1), (3, texts[4], 1), (4, texts[5], 1), (None, "", 1)]
    assert got == sorted(expected, key=str)
    mixed = docs.withColumn("source", F.lit("s"))
    assert corpus_pipeline.mix(spark, mixed, SMALL).columns == mixed.columns


def test_pipeline_equals_its_stages_by_brute_force(spark):
    """Every stage's decisions, recomputed plainly from what the one before it kept."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = {r.doc_id: r.text for r in corpus_pipeline.drop_near_copies(spark, docs, SMALL).collect()}
    bench = [set(zip(*(w[i:] for i in range(5)), strict=False)) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect() if (w := decontaminate.terms(r.text))]
    kept = {r.doc_id for r in corpus_pipeline.drop_leaks(spark, docs.filter(F.col("doc_id").isin(list(rows))), SMALL).collect()}
    for d, t in rows.items():
        w = decontaminate.terms(t)
        grams = set(zip(*(w[i:] for i in range(5)), strict=False))
        share = max((len(grams & b) / len(b) for b in bench if b), default=0)
        assert (d in kept) == (share < 0.8)
    ids = [r.doc_id for r in corpus_pipeline.run(spark, SMALL).collect()]
    assert set(ids) <= kept and max(Counter(ids).values()) <= 2


def test_registered_queries_equal_sql(spark):
    for name, sql in queries.ORACLES.items():
        db = duckdb.connect()
        for table in ("documents", "conversations"):
            db.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
        got = queries.QUERIES[name](spark, SMALL)
        expected = db.sql(f"SELECT {', '.join(got.columns)} FROM ({sql})").fetchall()
        assert Counter(map(tuple, got.collect())) == Counter(expected)
        db.close()
