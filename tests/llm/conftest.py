import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rid string, n long, key double, id string, ids int, h int, pos int"


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and long texts, ties, repeats, and columns named like internal ones."""
    rng = random.Random(3)
    words = ["the", "and", "of", "maison", "Straße", "niño", "tree", "x1", "été", "...", "42", "'s", "don't"]
    long = " ".join(rng.choice(words) for _ in range(60_000))
    base = [
        (1, "the cat sat on the mat and looked at the dog", "en"), (2, "the cat sat on the\tmat and looked at the dog ", "en"),
        (3, None, None), (4, "", "en"), (5, "  \n\t ", "fr"), (6, "1234 5678 !!", "de"), (7, long, "en"), (8, long + " ", "fr"),
        (9, "x", None), (9, "x", None), (10, "thecatsatonthematandlookedatthedog", "en"), (None, "the end", "en"), (None, None, None),
        (11, "<|endoftext|> a <|endoftext|>", "en"), (12, "a  b \n\n c d　 e", "es"), (13, "日本語 テキスト 😀 é́", None),
        (14, "y" * 5000, "en"), (15, " lead", "en"), (16, "trail ", "en"), (16, "trail other", "en"),
    ]
    base += [(100 + i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 60))), rng.choice(["en", "fr"])) for i in range(60)]
    return [(i, t, lang, rng.choice(["a", "b", None]), 0, "r", 1, 0.5, "q", 7, 8, 9) for i, t, lang in base]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
