"""More languages than the bound are an error, not left out."""

import pytest

from tidemark.llm import langid


def test_bound_of_languages(spark, docs):
    rows = docs([(i, f"word {'abcdefgh'[i % 8] * 3}", f"x{i % 8}", None) for i in range(80)])
    with pytest.raises(ValueError):
        langid.fit_languages(rows, max_languages=7)
    assert len(langid.fit_languages(rows, max_languages=8).families) == 8
