import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng: random.Random, n: int) -> str:
    """n invented words."""
    return " ".join("".join(rng.choice(["th", "er", "on", "an", "ñe", "ü"]) for _ in range(rng.randint(1, 5))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_texts():
    """Null, empty, blank, very long, repeated and hostile texts."""
    rng = random.Random(5)
    base = words(rng, 120)
    return [
        None, "", " \t\n", "a", "two words", base, base, base.replace("th", "TH"), words(rng, 60), words(rng, 4000),
        "x" * 5000, "ab" * 400 + " " * 300, "日本語 テキスト\n\n  foo's 1234", "a <|endoftext|> b", "\x1c\x85 a\x00b", "!!! ### @@@ ...",
        base + " " + words(rng, 3), base + " " + words(rng, 60), "same line\n" * 40,
    ]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_texts):
    rows = [(i, t, "en", "s", None) for i, t in enumerate(odd_texts)]
    rows += [(None, odd_texts[5], None, None, None), (5, odd_texts[5], "en", "s", None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
