"""A small corpus with the awkward cases: nulls, empty and long texts, copies, repeated rows, clashing columns."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row_key long, chunk string, size int"


def corpus() -> list[tuple]:
    rng = random.Random(7)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(900)]
    def words(n: int) -> list[str]:
        return [rng.choice(vocabulary) for _ in range(n)]
    def lines(w: list[str]) -> str:
        return "\n".join(" ".join(w[i:i + 12]) for i in range(0, len(w), 12))
    shared = " ".join(words(70))
    texts: list[str | None] = [lines(words(rng.randint(20, 160))) for _ in range(40)]
    base = words(120)
    for k in range(12):  # near copies that differ more and more
        w = base.copy()
        for _ in range(k):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        texts.append(lines(w))
    texts += [texts[0], texts[0], texts[1].upper(), lines(words(30)) + "\n" + shared, lines(words(45)) + "\n" + shared + "\n" + lines(words(10))]
    texts += [None, "", "   \n\t\n", "one", "one two three", "a a a a a a a a a a a a a a a", "Été  Straße x  y <|endoftext|> 'tis.\x1c!! \n\n z", "#*$%&|<> " * 12]
    texts += [lines(words(2500)), "abc" * 400, texts[3] + "\n" + texts[4]]
    rows = [(i, t, "en", [None, "a", "b", "é", "zz"][i % 5], 0, 5, "x", 1) for i, t in enumerate(texts)]
    return rows + [rows[2], (None, texts[5], "en", "a", 0, 5, "x", 1)]


@pytest.fixture(scope="session")
def rows() -> list[tuple]:
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
