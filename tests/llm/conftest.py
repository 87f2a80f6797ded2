"""Tables that every operator must stand: nulls anywhere, empty and long texts, repeats, clashing columns, no rows."""

import pytest

CLASH = "doc_id long, text string, lang string, source string, n_chars long, size int, keys string, `key` string, n int, ids string, rep long, tile string, part int, f long, a long, b long, w int, x string, path string, label string"


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with every oddity at once."""
    long = "long words of a long text, " * 20_000
    texts = [None, "", " \n\t ", "one", long, long, "ab", "ab", "▁ é\U0001f600 \u0000 x", "the same text here", "the same text here"]
    rows = [(i if i != 3 else None, t, None, f"s{i % 2}" if i % 3 else None, len(t or ""), 1, "k", "k", 1, "i", 7, "t", 1, 1, 1, 1, 1, "x", "p", "l") for i, t in enumerate(texts)]
    rows.append(rows[-1])  # a row that repeats, id and all
    return spark.createDataFrame(rows, CLASH)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
