import pytest

from runlake.llm.queries import prepared

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, `row` string, _doc string, `size` int, `a.b` string, key string"
PAGES = "page_id bigint, url string, html string, `row` string, text string, key string, `a.b` string"


@pytest.fixture(scope="session")
def ready(spark):
    """The session as the queries prepare it."""
    return prepared(spark)


@pytest.fixture(scope="session")
def prose():
    """``prose(seed, n)``: invented clean text of n words."""
    import random

    parts = "ther and tion ing er on ent heat stone river light under mountain window paper morning".split()

    def make(seed, n):
        r = random.Random(seed)
        words = ["".join(r.choice(parts) for _ in range(r.randint(1, 2))) for _ in range(n)]
        return " ".join(w + ("." if i % 11 == 10 else "") for i, w in enumerate(words))

    return make


@pytest.fixture(scope="session")
def odd_docs(ready, prose):
    """Nulls in every column, empty, blank, short and very long texts, ties, repeated rows, clashing column names."""
    long = prose(1, 40_000)
    texts = [
        (1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "one two three"), (6, long), (7, long), (8, prose(2, 120)), (8, prose(2, 120)),
        (8, prose(3, 120)), (None, prose(2, 120)), (None, None), (9, "\u00a0\u2028 caf\u00e9 \U0001f600 x"), (10, "|" * 5000), (11, "A" * 200_000),
        (12, prose(4, 90)), (13, prose(4, 90) + " end"),
    ]
    rows = [(i, t, None if n % 3 == 0 else "en", [None, "s1", "s2"][n % 3], None if t is None else len(t), "r", "d", n, "ab", None) for n, (i, t) in enumerate(texts)]
    return ready.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(ready):
    return ready.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def pages_of(ready):
    def make(rows):
        return ready.createDataFrame([(i, u, h, "r", "t", "k", "x") for i, u, h in rows], PAGES)

    return make
