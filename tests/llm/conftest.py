import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, digest string, n int, shard int, hits string, score double, component string, size int, key long"


def words(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps", "zeta"]) + str(rng.randrange(400)) for _ in range(n))


def rows():
    """Nulls everywhere, empty and very long texts, ties, repeated rows and ids, copies and near copies."""
    rng = random.Random(7)
    base = [words(rng, rng.randrange(5, 160)) for _ in range(40)]
    out = [(i, t) for i, t in enumerate(base)]
    out += [(100, None), (101, ""), (102, " \n\t"), (103, ""), (None, "text without an id"), (None, None), (None, base[3])]
    out += [(104, base[0]), (105, " ".join(base[0].split())), (106, base[0].replace(" ", "  ")), (0, base[0]), (3, base[3]), (3, base[4])]
    out += [(200 + i, base[20] + f" tail{i}") for i in range(30)]
    out += [(300, words(rng, 30_000)), (301, "x" * 200_000), (302, "ünïcödé 漢字 😀 " * 40), (303, "<|im_end|> \\ <\\|")]
    return [(i, t, rng.choice(["en", "de", None]), rng.choice(["hot", "hot", "cold", None]), None, 1, "d", 2, 3, "h", 0.5, "c", 4, 9) for i, t in out]


@pytest.fixture(scope="session")
def nasty(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
