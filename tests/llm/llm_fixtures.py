from __future__ import annotations

import pytest


@pytest.fixture
def docs_of(spark):
    """Documents from ``(doc_id, text, source, lang)`` with a column that clashes with added ones."""

    def make(rows):
        rows = [(*r, *[None] * (4 - len(r)), len(r[1] or ""), -1.0) for r in rows]
        return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long, score double")

    return make
