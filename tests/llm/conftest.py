import random

import pytest

from leeward.llm.shared import ship


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    ship(spark)


AWKWARD = [None, "", " \t\n", "a", "ein Wort", "word " * 300, "x" * 5000, "ab" * 3000, "é" * 400 + " ü" * 60]


@pytest.fixture(scope="session")
def corpus():
    """(id, text): copies, near copies, shared passages, awkward texts; ids are not in order of place."""
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(900)] + ["Ähre", "naïve", "日本"]
    shared = [" ".join(rng.choices(vocabulary, k=rng.choice([40, 55, 70]))) for _ in range(4)]
    texts = list(AWKWARD)
    for _ in range(50):
        words = rng.choices(vocabulary, k=rng.choice([2, 6, 30, 80, 200]))
        if rng.random() < 0.4:
            at = rng.randrange(len(words))
            words[at:at] = shared[rng.randrange(4)].split()
        texts.append(" ".join(words))
        for _ in range(rng.choice([0, 0, 1, 3])):
            copy = list(words)
            for _ in range(rng.choice([0, 1, 4])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(rng.choice([" ", "\n"]).join(copy) if rng.random() < 0.9 else " ".join(copy).upper())
    ids = rng.sample(range(10_000), len(texts))
    return list(zip(ids, texts))


@pytest.fixture(scope="session")
def documents(spark, corpus):
    """The corpus as a table that brings columns with names the operators use themselves."""
    rows = [(i, t, "en", f"s{i % 3}" if i % 7 else None, len(t or ""), 1.5, "k", 7) for i, t in corpus]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, h double, bucket string, target int").repartition(3)
