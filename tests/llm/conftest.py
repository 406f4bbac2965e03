import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, labels string, term string, h long, words string, fp long, id string, n long, doc string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null, empty, blank, repeated, very long and non-Latin texts, null and repeated ids, and columns with clashing names."""
    rng = random.Random(3)
    words = ["alpha", "Beta", "gamma", "MIT", "License", "delta", "été", "ÉTÉ", "x1", "und", "the", "of"]
    sentence = lambda n: " ".join(rng.choice(words) for _ in range(n))
    long = sentence(400_000)
    texts = [
        (1, None), (2, ""), (3, " \t\n\x0b\r "), (4, "one"), (5, "two words"), (6, "under the MIT License, see"), (6, "under the MIT License, see"), (7, "Apache License then general PUBLIC license"),
        (None, "no id here but words"), (None, None), (8, long), (9, sentence(50)), (10, sentence(50)), (9, "the same id, another text"), (11, "日本語のテキスト \u2603 \U0001f600 <|endoftext|> tail"),
        (12, "a\x00b\x1fc\u00a0d\u2028e"), (13, "12345 --- !!!"), (14, "don't we'll THEY'RE  double  spaces \n\n end "), (15, sentence(300)), (16, "µ ª º × ÷ ß ÿ Ā"), (17, "one"),
    ]
    rows = [(i, t, rng.choice(["en", "fr", None]), "s", 1, 0.5, "x", "y", 7, "w", 3, "z", 1, "q") for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
