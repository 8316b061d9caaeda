import pytest

ODD = [None, "", " ", "\n", "a", "...", "one two three", "😀 é ß", "x" * 20_000, "ab " * 20_000, "9" * 5_000, "1 " * 5_000]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty and very long texts, repeated rows, extra columns with clashing names."""
    rows = [(i, t, "en" if i % 2 else None, f"src{i % 3}" if i % 4 else None, None, i) for i, t in enumerate(ODD)] + [(None, None, None, None, None, None), (3, "\n", "en", "src0", None, 3), (3, "\n", "en", "src0", None, 3)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score long")


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
