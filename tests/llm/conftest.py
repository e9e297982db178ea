from __future__ import annotations

import pytest
from made import made_documents


@pytest.fixture(scope="session")
def documents(spark):
    """With extra columns whose names the operators use inside."""
    rows = [(*r, len(r[1] or ""), 1, "x", 2.0, True) for r in made_documents()]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, h int, start string, score double, alive boolean").repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(documents):
    return documents.limit(0)
