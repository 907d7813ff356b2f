import random

import pytest

#: More columns than the operators know, with names that they use themselves.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fingerprint string, rank int, size string, term string"


def odd_texts():
    random.seed(11)
    words = ["the", "house", "was", "red", "And", "Über", "größe", "niño", "ça", "été", "x1", "42", "!?"]
    base = [" ".join(random.choices(words, k=random.randint(1, 60))) for _ in range(60)]
    near = [base[0] + " tail", base[0].replace("the", "that", 1), base[1], base[1]]
    odd = ["", " \n\t ", "one", "one two", "漢字 😀  x", "a" * 5000, "word " * 8000, "<|endoftext|> 's 'll x"]
    return base + near + odd + [None, None]


@pytest.fixture(scope="session")
def odd_docs(spark):
    texts = odd_texts()
    rows = [
        (i * 7 % 101, t, ["en", "de", None][i % 3], ["a", "b", None][i % 3] if i % 2 else "a", len(t or ""), "f", 1, "s", "t")
        for i, t in enumerate(texts)
    ]
    rows += [rows[3], rows[3], (None, "no id at all", "en", "a", 12, "f", 1, "s", "t"), (None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
