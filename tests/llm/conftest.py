import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, keep_id bigint, run string, size int, digest string, rep int"


@pytest.fixture(scope="session")
def messy(spark):
    """Documents with nulls, empty and long texts, ties, repeated rows and clashing column names."""
    rng = random.Random(5)
    vocab = [f"w{k}" for k in range(200)] + ["the", "of", "and", "der", "la"]
    base = [" ".join(rng.choice(vocab) for _ in range(rng.randint(25, 90))) for _ in range(12)]
    texts = [None, "", "   \n\t", "one two", "ONE two", " one\ttwo ", "x" * 5000, "word " * 4000, "é漢🎉   the", "<|endoftext|> a"]
    for b in base:
        words = b.split()
        texts += [b, b, b.upper(), b + " more", " ".join(words[: len(words) // 2]), b.replace(" ", "  ")]
        words[3] = "changed"
        texts.append(" ".join(words))
    rows = [(k, t, [None, "en", "de"][k % 3], [None, "a", "b", "ü"][k % 4], None if t is None else len(t)) for k, t in enumerate(texts)]
    rows += [rows[3], rows[10], (None, "one two", "en", "a", 7), (None, None, None, None, None), (7, base[0], "fr", "a", 1)]
    return spark.createDataFrame([(*r, 1, "x", 2, "y", 3) for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
