"""Odd documents that every operator must take: nulls, empty and long texts, ties, repeats, clashing columns."""

import random

import pytest

PROSE = "the of and to in that was his with for had you not be her is at but by this which or from they were all him so what"


def prose(seed: int, n: int) -> str:
    pick = random.Random(seed)
    return " ".join(pick.choice(PROSE.split()) + pick.choice(["", "a", "er", "ing", "ly"]) + str(pick.randrange(400)) for _ in range(n))


def edited(text: str, seed: int, share: float) -> str:
    pick = random.Random(seed)
    return " ".join(w if pick.random() > share else f"x{pick.randrange(9999)}" for w in text.split())


@pytest.fixture(scope="session")
def texts():
    """(doc_id, text, source): near and exact copies, shared passages, junk, nulls, a very long text."""
    base = [prose(i, 120) for i in range(12)]
    passage = prose(99, 70)
    rows = [(i, t, f"s{i % 3}") for i, t in enumerate(base)]
    rows += [(20 + i, edited(base[0], i, 0.01), "s0") for i in range(5)]
    rows += [(30 + i, base[1], "s1") for i in range(4)]
    rows += [(40 + i, f"{prose(200 + i, 60)} {passage} {prose(300 + i, 60)}", "s2") for i in range(4)]
    rows += [(50, None, None), (51, "", "s0"), (52, " \n\t ", "s1"), (53, "word", "bad"), (54, "one two three", "bad"), (55, "Ünï çødé 日本語 ~<[|>] </s>", "bad")]
    rows += [(60, "ab " * 20_000, "s0"), (61, "z" * 50_000, "s0"), (62, "same line\nsame line\n\nsame line", "bad"), (63, prose(777, 3000), "s2")]
    rows += [(0, base[0], "s0"), (None, base[2], None)]  # a repeated row, and one without an id
    return rows


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The rows with columns whose names clash with those that operators make up."""
    rows = [(i, t, s, "en", len(t or ""), "x", 1, 2) for i, t, s in texts]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long, host string, node int, start int").repartition(3)
