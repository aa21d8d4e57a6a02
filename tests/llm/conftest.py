from __future__ import annotations

import pytest

TEXTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def make_docs(spark):
    """Documents from (doc_id, text[, lang[, source]]) tuples; extra columns clash with nothing."""

    def make(*rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "a", len(r[1] or ""), "x", 1, "y") for r in rows]
        # columns whose names the operators use inside
        return spark.createDataFrame(full, TEXTS + ", node string, copies int, score string")

    return make


@pytest.fixture
def make_labels(spark):
    def make(*rows):
        return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")

    return make
