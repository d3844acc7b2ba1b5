"""Fixtures of the operators' tests."""

import pytest

WEIRD = ["", " \n\t", "a", "word " * 3000, "x" * 20000, "\u0000 nul", "\U0001f600 ünï   cödé", "dup dup", "dup dup"]


@pytest.fixture(scope="session")
def weird(spark):
    """Null, empty, very long and repeated texts, null ids and sources, and a column whose name clashes."""
    rows = [(i, t, "en" if i % 2 else None, "s" if i % 3 else None, 7.5) for i, t in enumerate(WEIRD)]
    rows += [(None, "no id", "en", "s", 1.0), (50, None, None, None, None), (51, "twice", "de", "s", 1.0), (51, "twice", "de", "s", 1.0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score double")
