import random

import pytest


@pytest.fixture(scope="session")
def make_docs(spark):
    """Rows (doc_id, text) as a table with extra columns whose names clash with the operators' own."""

    def make(rows, partitions=3):
        schema = "doc_id long, text string, source string, n_words long, spans string, score double, kept boolean, place long"
        return spark.createDataFrame([(i, t, f"s{(i or 0) % 3}", 1, "x", 0.5, True, 7) for i, t in rows], schema).repartition(partitions)

    return make


@pytest.fixture(scope="session")
def corpus():
    """Documents with copies, near copies, shared passages, one-word, empty, null and very long texts."""
    rnd = random.Random(5)
    words = ["".join(rnd.choice("abcdeéü") for _ in range(rnd.randint(1, 6))) for _ in range(400)]
    text = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    base, passage = text(120), text(60)
    rows = [(0, text(100)), (1, base), (2, base), (3, base.upper()), (4, None), (5, ""), (6, "word"), (7, "word"), (8, "two words"), (9, text(3000))]
    for i in range(10, 40):
        w = base.split()
        for _ in range(i % 6):
            w[rnd.randrange(len(w))] = rnd.choice(words)
        rows.append((i, " ".join(w)))
    for i in range(40, 60):
        rows.append((i, f"{text(30)}\n{passage}\t{text(rnd.randint(0, 30))} "))
    rows += [(60, "a " * 400), (61, "a " * 300), (62, " \t\n\x0b "), (63, text(40)), (64, None)]
    return rows
