"""Small tables with the awkward rows that every operator has to stand."""

from __future__ import annotations

import pytest

from quitanda.llm.entries import ship_code

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(n: int, step: int = 1) -> str:
    return " ".join(f"{WORDS[(i * step + i // 7) % len(WORDS)]}{(i * step) % 53}" for i in range(n))


LINE = "A Shared Line that is rather longer than forty characters"
DOCS = [
    (1, prose(80)),
    (2, prose(80) + " tail"),
    (3, prose(80).upper()),
    (4, None),
    (5, ""),
    (6, "one two"),
    (7, "One  two\t"),
    (8, prose(90, 3) + f"\n  {LINE}  \nrest"),
    *((20 + i, f"{prose(60, 5 + i)}\n{LINE.lower() if i % 2 else LINE}\n\nend {i}") for i in range(6)),
    (30, prose(30_000, 7)),
    (31, "x" * 20_000),
    (8, prose(90, 3) + f"\n  {LINE}  \nrest"),
    (None, prose(70, 2)),
    (None, None),
    (40, "spam " * 200),
    (41, "ünï </s>[INST] ok [/INST] <|endoftext|> 日本 Σ x"),
]


@pytest.fixture(scope="session", autouse=True)
def code(spark):
    ship_code(spark)


@pytest.fixture(scope="session")
def docs(spark):
    """Documents with nulls, empty, long, repeated and tied rows, and columns whose names clash."""
    rows = [(i, t, "k", 1.0, 7) for i, t in DOCS]
    return spark.createDataFrame(rows, "doc_id long, text string, key string, score double, kept int").repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, key string")
