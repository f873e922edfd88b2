import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size int, words string, kept string, block int, part int"


def awkward():
    """Nulls in every column, empty and long texts, ties, repeated rows, and extra columns with clashing names."""
    rng = random.Random(7)
    vocabulary = ["the", "of", "and", "Zürich", "naïve", "idiot", "x1", "日本語", "don't", "a@b.example.org", "10.0.0.1", "emoji😀"] + [f"w{i}" for i in range(300)]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    base = say(120)
    rows = [
        (1, None, None, None), (None, "a null id has a text " + say(60), "en", "s1"), (2, "", "en", "s1"), (3, "   \n\t ", "en", None), (4, base, "en", "s2"), (5, base, "en", "s2"), (5, base, "en", "s2"),
        (6, base.replace("w1", "w2", 2), "en", "s3"), (7, "one two three", "de", "s3"), (8, "x" * 3000, None, "s1"), (9, say(6000), "en", "s4"), (10, "THE Of\n\nAND  the\r\n\x0bof  and " + say(50) + " ", "fr", "s4"),
        (-11, base[:200] + say(40) + base[-200:], "en", "s2"), (12, "z" + base + " tail", "en", "s2"), (None, None, None, None), (None, base, None, "s9"), (13, "ab " * 400, "es", "s1"), (14, "'s 're it's  I'll 123 45     x　y " * 3, "es", "s1"),
    ]
    rows += [(100 + i, say(rng.randrange(20, 200)), rng.choice(["en", "de", None]), f"s{i % 5}") for i in range(40)]
    return [(a, b, c, d, None, 9, "w", None, 3, 4) for a, b, c, d in rows]


@pytest.fixture(scope="session")
def odd_docs(spark):
    return spark.createDataFrame(awkward(), SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def odd_rows():
    return [r[:5] for r in awkward()]
