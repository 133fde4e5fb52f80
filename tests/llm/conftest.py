import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, k long, t string, sid long, rank string, shard int, label double, domain string"


def rows_of(texts, first=0):
    """Documents with columns whose names the operators use themselves."""
    return [(i + first, x, "en", "src0", len(x or ""), "x", 1, "t", 2, "r", 3, 0.5, "d") for i, x in enumerate(texts)]


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(["ba", "de", "ki", "lo", "mu", "ré"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    base = [prose(i, 60 + 7 * i) for i in range(12)]
    long = prose(99, 20_000)
    words = base[3].split()
    near = " ".join([*words[:40], "changed", *words[41:]])
    return [*base, base[0], base[0], near, near.upper(), None, "", " \n\t ", "one", "One", "two words", long, long, "x" * 5000, "é" * 300, base[5] + "\n" + base[6], "It's 10% <|endoftext|> ok\u00a0go\x1cgo e\u0301"]


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = rows_of(texts)
    extra = rows_of(["no id", "no id"], 0)
    extra = [(None, *r[1:]) for r in extra]
    return spark.createDataFrame([*rows, *extra, rows[1], rows[1]], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
