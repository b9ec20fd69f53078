import pytest
from pyspark.sql import functions as F


@pytest.fixture
def odd(spark):
    """Documents with nulls, an empty and a very long text, repeated rows and extra columns."""
    words = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
    rows = [
        (1, "one two three four five", "en", "a", 23, "x"), (1, "one two three four five", "en", "a", 23, "y"),
        (2, None, None, None, None, None), (None, "one two three four five six", "en", None, 27, "z"), (3, "", "de", "b", 0, ""),
        (4, "  \n\t ", "de", "b", 5, ""), (5, words, "en", "a", len(words), "q"), (6, "ONE two THREE four five", "en", "a", 23, "x"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, extra string")
    # names that the operators might use themselves
    return df.withColumns({"id": F.lit(7), "kept": F.lit("no"), "n_words": F.lit("many"), "size": F.lit(0), "token": F.lit(0)})


@pytest.fixture
def none(odd):
    return odd.limit(0)
