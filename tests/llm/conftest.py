import pytest

LONG = "word " * 200_000 + "end"
SCHEMA = "c0 string, doc_id long, text string, row long, fp string, lang string, source string, key_id long, copies int, n_chars long"
ROWS = [
    (1, "the cat sat on the mat and looked at the dog over there\nsecond line of it", "en", "a"),
    (1, "the cat sat on the mat and looked at the dog over there\nsecond line of it", "en", "a"),  # repeated row
    (2, "the cat sat on the mat and looked at the dog over there\nsecond line of it", "en", "b"),  # equal text
    (3, None, "en", "a"), (4, "", None, "b"), (5, " \t\n\x0b\x0c\r ", "fr", None), (None, "a row without an id but with words", "en", None),
    (None, None, None, None), (6, "x", "de", "b"), (7, LONG, "en", "a"), (8, "été là où ça 日本語 😀 <|endoftext|> ▁<s>", "fr", "c"), (8, "tie of the id", "en", "c"),
    (9, " no-break    blanks \x00 and controls \x1f", "en", "c"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty, blank and very long texts, ties, repeated rows, and columns with names that operators use inside."""
    return spark.createDataFrame([("x", i, t, 5, "y", lang, s, 7, 2, len(t or "")) for i, t, lang, s in ROWS], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(odd):
    """The same columns without rows."""
    return odd.where("false")


def union_find(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return [find(x) for x in range(n)]
