import random

import pytest

WORDS = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "ter") for b in ("na", "ru", "shi", "pel") for c in ("", "s", "ta", "vo")]


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n))


@pytest.fixture(scope="session")
def odd_docs():
    """Rows (doc_id, text, lang): nulls, empty and long texts, ties, repeated rows, shared passages, near copies."""
    passage = prose(1, 60)
    base = prose(2, 300).split()
    near = base.copy()
    near[150] = "changed"
    rows = [
        (1, f"{prose(3, 40)} {passage} {prose(4, 30)}", "en"), (2, f"{prose(5, 20)}\n{passage}\t{prose(6, 25)}", "en"), (3, passage, None),
        (4, None, "fr"), (5, "", "fr"), (6, "one two", "de"), (7, "one two", "de"), (7, "one two", "de"), (8, " ".join(base), "en"), (9, " ".join(near), "en"),
        (10, " ".join(base), "es"), (None, " ".join(base), "es"), (None, None, None), (11, prose(7, 6000), "en"), (12, "la " * 400, "fr"), (13, "ünï çödé 日本語 🎉 " * 9, None),
        (14, "one two", "de"), (7, prose(8, 50), "de"),
    ]
    return rows


@pytest.fixture(scope="session")
def docs(spark, odd_docs):
    """The rows with columns whose names clash with those that operators add or use inside."""
    rows = [(*r, i, i, "x", float(i), True) for i, r in enumerate(odd_docs)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, id int, key int, hash string, score double, kept boolean").repartition(3)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
