import pytest

from quotemill.llm.common import table
from tests.conftest import SMALL

LONG = " ".join(f"word{i % 977} and,{i}" for i in range(60_000))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, raw string, kept boolean, key long, __x string"


@pytest.fixture(scope="session")
def small(spark):
    """The documents of the smallest data folder."""
    return table(spark, SMALL, "documents")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows, ties, and columns whose names clash."""
    texts = [
        (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "one"), (5, "one"), (6, "o n e"), (None, "one"), (None, None),
        (7, LONG), (8, LONG + " more"), (9, "Ein kurzer Satz über nichts."), (10, "un petit texte été"), (11, "1234 !!! ???"),
        (12, "\x00\x1f odd   signs \U0001f600   end"), (13, "all rights reserved, mail me at a@b.c or +1 (555) 123-4567"),
    ]
    rows = [(i, t, None if i in (9, None) else "de", None, -1, "r", False, 7, "x") for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
