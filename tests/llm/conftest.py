import pytest
from helpers import CLASHES


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and very long texts, ties, repeated rows and clashing extra columns."""
    long = " ".join(f"word{i % 977} the" for i in range(40_000))
    rows = [
        (1, "alpha beta gamma delta epsilon zeta"), (2, "alpha  beta gamma delta epsilon zeta "), (3, None), (4, ""), (5, " \n\t "),
        (6, long), (7, long + "\n"), (None, "alpha beta gamma delta epsilon zeta"), (None, None), (8, "You idiot, you MORON!!"),
        (8, "You idiot, you MORON!!"), (9, "Élan vital — 中文 😀 été x"), (10, "Released under the MIT License. Licensed under CC BY-NC 4.0."),
        (11, "a"), (12, "\x00 \x1c b"), (13, "one two"), (14, "ONE two"),
    ]
    extra = [f"'{c}' AS `{c}`" for c in CLASHES]
    return spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("doc_id", "text", *extra).coalesce(2)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, lang string")
