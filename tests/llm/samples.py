import pytest

WORDS = "amber basil cedar delta ember fjord grape heron ivory jolly karst lemon maple noble ocean pearl quill raven stone tulip".split()


def prose(seed: int, n: int) -> str:
    """Text of n words without a short period."""
    x, out = seed * 7919 + 13, []
    for _ in range(n):
        x = (x * 1103515245 + 12345) % 2**31
        out.append(WORDS[(x >> 8) % len(WORDS)] + WORDS[(x >> 16) % len(WORDS)][: 1 + (x >> 4) % 4])
    return " ".join(out)


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    """Documents with nulls in every column, empty and long texts, repeated rows and ids, and an extra column."""
    rows = [
        (1, prose(1, 120), "en", "a", 1, "x"), (2, prose(1, 120), "en", "b", 1, "x"), (3, prose(2, 90), "en", "a", 1, None),
        (4, "", "en", "a", 0, "x"), (5, None, "en", None, None, "x"), (6, prose(3, 4000), None, "c", 1, "x"),
        (6, prose(3, 4000), None, "c", 1, "x"), (None, prose(4, 60), "en", "a", 1, "x"), (None, prose(4, 60), "en", "a", 1, "x"),
        (7, "one", "en", "b", 3, "x"), (7, "two words", "en", "b", 3, "x"), (8, "  \n\t ", "de", "c", 5, "x"),
        (9, "Größe und 日本語 text — ok\n\nnaïve", "de", "c", 5, "x"),
    ]
    return spark.createDataFrame(rows, DOCS + ", fp string").cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
