from __future__ import annotations

import random

import pytest


def words(rng: random.Random, n: int) -> str:
    pool = ["alpha", "beta", "gamma", "delta", "omega", "sigma", "été", "straße", "naïve", "zeta"]
    return " ".join(rng.choice(pool) + rng.choice("abcdefghij") * rng.randint(0, 3) for _ in range(n))


def odd_texts() -> list[str | None]:
    """Nulls, blanks, repeats, near copies, shared passages, long words, periodic and very long texts."""
    rng = random.Random(7)
    passage, long = words(rng, 80), words(rng, 300)
    near = long.split()
    near[150] = "changed"
    return [
        None,
        "",
        " \n\t ",
        "one",
        "one two three",
        "one two three",
        long,
        long,
        " ".join(near),
        words(rng, 40) + "\n" + passage + "\n" + words(rng, 40),
        passage + " " + words(rng, 30),
        words(rng, 20) + passage,
        "ab" * 400,
        "x" * 5000,
        " ".join(["same"] * 200),
        words(rng, 12) + "\n" + words(rng, 12) + "\r\n\r\n" + words(rng, 5),
        words(rng, 6000),
        "naïve été straße   x\x1cy  z",
    ]


@pytest.fixture(scope="session")
def odd(spark):
    """Texts by id, and a table of them with extra columns whose names the operators use themselves."""
    texts = dict(enumerate(odd_texts()))
    rows = [(i, t, f"s{i % 3}", 1, "u", b"r", 0) for i, t in texts.items()]
    schema = "doc_id long, text string, source string, uid int, row string, records binary, n_chars long"
    return texts, spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="session")
def repeated(spark):
    """Repeated rows and null ids."""
    text = words(random.Random(3), 120)
    rows = [(5, text), (5, text), (None, text), (None, None), (7, "another text altogether, short"), (2, text + " more")]
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string")
