import random

import pytest

CLASHING = "key fp slot a b at block cell row rank size target source_size component part own word line n k s v _n _hash _before path host own cosine".split()


def words(rng, n, low=0, high=400):
    return " ".join(f"w{rng.randrange(low, high)}x" for _ in range(n))


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text, source) rows, with columns of names the operators use themselves."""

    def build(rows):
        extra = dict.fromkeys(CLASHING, 1)
        schema = "doc_id long, text string, source string, lang string, " + ", ".join(f"`{c}` int" for c in extra)
        return spark.createDataFrame([(d, t, s, "en", *extra.values()) for d, t, s in rows], schema)

    return build


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and blank texts, a very long one, exact and near copies, repeated rows, a hot source."""
    rng = random.Random(3)
    rows = [(i, words(rng, 60), "hot" if i % 3 else f"s{i % 7}") for i in range(40)]
    base = words(rng, 120)
    rows += [(100 + i, base, "hot") for i in range(6)]
    rows += [(110 + i, base + f" tail{i}", "hot") for i in range(6)]
    rows += [(200, None, "hot"), (201, "", None), (202, " \n\t ", "s1"), (None, "no id here", "s2"), (203, "one", None)]
    rows += [(204, "É ΑΣ naïve ﬁ <|endoftext|> İ it's. A-B", "s1"), (205, words(rng, 30_000, 0, 9000), "hot")]
    rows += [(206, "same row", "s1"), (206, "same row", "s1"), (207, "x" * 900, "s2"), (208, words(rng, 3), "s2")]
    return rows


@pytest.fixture(scope="session")
def odd(make, odd_rows):
    return make(odd_rows).repartition(3)


@pytest.fixture(scope="session")
def none(make):
    return make([])
