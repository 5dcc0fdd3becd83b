"""Fixtures of the corpus operators' tests."""

import pytest

DDL = "text string, doc_id long, lang string, source string, n_chars long, words string, key string, salt int"


@pytest.fixture
def make_docs(spark):
    """documents with extra columns whose names clash with the operators' own."""

    def make(texts, ids=None, langs=None):
        ids = list(range(len(texts))) if ids is None else ids
        langs = ["en"] * len(texts) if langs is None else langs
        return spark.createDataFrame([(t, i, l, "s", 0, "w", "k", 1) for t, i, l in zip(texts, ids, langs, strict=True)], DDL)

    return make
