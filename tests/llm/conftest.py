import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _w string, size string, key string, rank long, h string"


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns that clash with internal ones."""
    rng = random.Random(5)
    base = words(rng, 60)
    near = base.replace("w", "x", 1)
    texts = [
        None, "", " \t\n ", "one", "two words", base, base, near, base + "\n" + words(rng, 70), words(rng, 70) + "\n" + base, "a b " * 4000, words(rng, 30_000, 50_000),
        "ÀÉ ß日本  x", "#" * 50, "same line here now ok\n" * 20, "\\### Assistant: </turn> ok", "you are a stupid idiot", words(rng, 12), words(rng, 12),
    ]
    rows = [(i, t, "en", f"s{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, base, None, None, None), (None, None, None, None, None), (40, words(rng, 25), None, "s0", 1)]
    return [(*r, "x", None, "k", 1, None) for r in rows]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def corpus(spark):
    """A small corpus with a hot source, copies, near copies and shared passages."""
    rng = random.Random(9)
    passage = words(rng, 65)
    seed = words(rng, 200)
    rows = []
    for i in range(240):
        kind = i % 6
        if kind == 0:
            text = seed if i % 12 else seed.replace(f" {seed.split()[i % 190]} ", " swapped ", 1)
        elif kind == 1:
            text = words(rng, 40) + "\n" + passage + "\n" + words(rng, 30)
        else:
            text = "\n".join(words(rng, rng.randrange(5, 60)) for _ in range(rng.randrange(1, 8)))
        rows.append((i, text, "en", "hot" if i % 3 else f"s{i % 7}", len(text)))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).cache()
