import random

import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def words():
    rng = random.Random(5)
    return ["".join(rng.choice(["the", "an", "or", "sh", "ti", "on", "re", "ea", "nd", "wh", "é"]) for _ in range(rng.randint(1, 4))) for _ in range(400)]


@pytest.fixture(scope="session")
def prose(words):
    """A function that makes n words of text from a seed, with sentence marks and lines."""

    def make(seed, n):
        rng = random.Random(seed)
        out = []
        for k in range(n):
            w = rng.choice(words)
            out.append(w.capitalize() if rng.random() < 0.1 else w)
            if rng.random() < 0.1:
                out[-1] += rng.choice([".", ",", ".\n"])
        return " ".join(out).replace("\n ", "\n")

    return make


@pytest.fixture(scope="session")
def odd_rows(prose):
    """Null and empty texts, white space, a very long text, repeated rows, ids that are null or shared."""
    long = prose(99, 30_000)
    return [
        (1, None, "en", "s", 0), (2, "", "en", "s", 0), (3, " \n\t ", None, "s", 4), (4, long, "en", None, len(long)), (5, "x", "xx", "s", 1),
        (6, prose(6, 60), "en", "s", 1), (6, prose(6, 60), "en", "s", 1), (7, prose(6, 60), "de", "s", 1), (8, prose(8, 60), None, "s", 1), (None, prose(9, 60), "en", "s", 1), (9, "a" * 20_000, "en", "s", 1), (10, "\u2581 \0 \U0001f642 <|endoftext|>  end ", "en", "s", 1),
    ]


@pytest.fixture
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, DOCUMENTS)


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], DOCUMENTS)
