import pytest

from logweft.llm.common import ship
from logweft.llm.queries import vocabulary


@pytest.fixture(scope="session")
def llm(spark):
    return ship(spark)


@pytest.fixture(scope="session")
def path():
    return vocabulary()


DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

# Nulls in every column, empty and blank texts, repeated rows, a null id twice.
ODD_ROWS = [
    (1, "The quick brown fox jumps over the lazy dog.\nIt's 5 o'clock", "en", "a", 10),
    (2, None, "en", None, None),
    (3, "", None, "a", 0),
    (4, " \t\n ", "de", "b", 4),
    (5, "Straße İstanbul ΣΑΣ é́ 日本語 <|endoftext|> a\x1cb c", "de", "b", 9),
    (5, "Straße İstanbul ΣΑΣ é́ 日本語 <|endoftext|> a\x1cb c", "de", "b", 9),
    (None, "no id at all", None, None, None),
    (None, "no id at all", None, None, None),
    (6, "word " * 9000, "en", "a", 45000),
    (7, "x" * 30000, "en", "a", 30000),
]


@pytest.fixture(scope="session")
def odd(llm):
    return llm.createDataFrame(ODD_ROWS, DOC_SCHEMA)


@pytest.fixture(scope="session")
def sf_small():
    return "/root/testdata/sf0.001"
