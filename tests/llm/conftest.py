import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Nulls in each column, empty and white texts, repeats, a long text, ties.
ODD = [
    (1, "Hello   there\tworld of words and more", "en", "a", 3),
    (2, "Hello there world of words and more", "en", None, None),
    (3, None, "en", "a", 0),
    (4, "", None, "a", 0),
    (5, " \n\t ", "de", "a", 0),
    (6, "one two", "de", "a", 0),
    (6, "one two", "de", "a", 0),
    (7, "ONE two", "de", "a", 0),
    (8, "word%d " * 3000 % tuple(range(3000)), "en", "a", 0),
    (9, "x" * 30000, "en", "a", 0),
    (10, "!!! 123 ---", "en", "a", 0),
    (11, "día <|endoftext|> ñandú 日本 🙂 é ΣΑΣ   \x85 \x1c x", "es", "a", 0),
    (None, "one two", None, None, None),
    (12, "a  b   c    d\n\n\n e \r\n f", "en", "a", 0),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Odd rows, with extra columns named like results and work columns of the operators."""
    from pyspark.sql import functions as F

    clash = {"kept": F.lit("x"), "length": F.lit("y"), "shard": F.lit("z"), "score": F.lit("s"), "digest": F.lit("d"), "size": F.lit("t"), "n_words": F.lit("w"), "held_out": F.lit("h")}
    return spark.createDataFrame(ODD, DOCS).withColumns(clash).persist()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
