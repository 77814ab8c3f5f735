"""Queries that read sentences, compared with their SQL where sentences begin and end with the digits of their place."""

import pytest
from compare import compare
from loomgrain.plans import catalogue

TEXTS = ["0.5 is half. 1 is one! 2 and 2. 33 is 3", "0", "00 begins. Ends 10", "10. 21. 32\n\nx 0. 1y 1. 2z", "Alpha 0! 1 beta 1? 2 gamma 2. " * 40, None, ""]


@pytest.fixture(scope="module")
def digits(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("digits")
    rows = [(i, text, "en", "web0", len(text or "")) for i, text in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").toPandas().to_parquet(path / "documents.parquet")
    return str(path)


@pytest.mark.parametrize("name", ["qa_rows", "recursive_chunks", "semantic_chunks"])
def test_digits_at_sentence_edges(spark, digits, name):
    assert compare(spark, catalogue.queries()[name], catalogue.oracle_sql()[name], digits) > 0


@pytest.fixture(scope="module")
def separators(spark, tmp_path_factory):
    """Characters that Python takes for white space, and SQL and the expressions do not; long lines, so that they are cut."""
    path = tmp_path_factory.mktemp("separators")
    texts = ["a\x1cb\x1d. " * 400, "\x1e one, two\x1f; \x1c three " * 300, "\x1f", "x\x1c" * 700, "x \x1d\x1e y. " * 500]
    rows = [(i, text, "en", "web0", len(text)) for i, text in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").toPandas().to_parquet(path / "documents.parquet")
    return str(path)


@pytest.mark.parametrize("name", ["qa_rows", "recursive_chunks", "semantic_chunks", "structure_chunks"])
def test_separators_are_no_white_space(spark, separators, name):
    assert compare(spark, catalogue.queries()[name], catalogue.oracle_sql()[name], separators) > 0
