"""Texts that try every operator: words of a small vocabulary with copies, near copies, empty, null and very long ones."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, html string, component long"


def make_texts(seed=3, n=60):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(1, 7))) for _ in range(300)]
    texts = []
    for _ in range(n):
        texts.append(" ".join(r.choice(vocabulary) for _ in range(r.randint(1, 80))))
    for i in range(12):  # near copies of growing distance
        words = texts[i].split()
        for _ in range(i):
            words[r.randrange(len(words))] = r.choice(vocabulary)
        texts.append(" ".join(words))
    base = " ".join(r.choice(vocabulary) for _ in range(120)).split()
    for i in range(25):  # a family of edited copies
        words = list(base)
        for _ in range(r.randint(0, 4)):
            words[r.randrange(len(words))] = r.choice(vocabulary)
        texts.append(" ".join(words))
    texts += [texts[0], texts[0].upper(), texts[1] + " ", "", None, " ", "\n\t", "one", "One", "two words", "É é ß", "a\x1cb \x0b c",
              "123 456 ... !!", "…", "x" * 5000, "lo ng. " * 4000, "tail▁mark  two   spaces ", "日本語のテキスト 日本", "<|endoftext|> <|EndOfText|>"]
    return texts


@pytest.fixture(scope="session")
def texts():
    return make_texts()


@pytest.fixture(scope="session")
def docs(spark, texts):
    """Keys not in row order; extra columns with the names of results."""
    rows = [((i * 37) % 1009, t, "en" if i % 3 else None, f"s{i % 4}" if i % 7 else None, 0, "x", 5) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def odd(spark, texts):
    """Null keys and repeated rows besides."""
    rows = [((i * 37) % 1009, t, "en" if i % 3 else None, f"s{i % 4}", 0, "x", 5) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows + rows[:5] + [(None, texts[0], None, None, None, None, None), (None, None, None, None, None, None, None)], SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
