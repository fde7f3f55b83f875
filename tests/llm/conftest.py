"""Tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import pytest

ROWS = [
    (1, "The cat sat on the mat and then it ran away from the big old dog in the yard today again", "en", "a"),
    (2, "The cat sat on the mat and then it ran away from the big old dog in the yard today again", "en", "a"),
    (3, "the CAT sat on the mat and then it ran away from the big old dog in the yard today again once", None, "b"),
    (4, None, "en", None),
    (5, "", "de", "b"),
    (6, "word", "fr", "a"),
    (7, "x\n\nx\nx y\nx y\n  \n#$% é中😀", "fr", "b"),
    (8, "  <|endoftext|>don't\tstop 123 ÀÉ!!  <|endoftext|>", "es", "c"),
    (9, " ".join(f"w{i % 97}" for i in range(30000)), "en", "c"),
    (9, " ".join(f"w{i % 97}" for i in range(30000)), "en", "c"),
    (10, "Licensed under the MIT License. CC-BY general public\tlicense; All rights reserved. cc by", "en", "a"),
]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string").repartition(3)


@pytest.fixture(scope="session")
def none(docs):
    return docs.limit(0)
