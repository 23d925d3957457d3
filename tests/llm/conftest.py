from __future__ import annotations

import pytest

from speclake.llm.shared import prepared


@pytest.fixture(autouse=True)
def _prepared(spark):
    prepared(spark)


@pytest.fixture
def documents(spark):
    """Rows (doc_id, text) with columns of clashing names beside them."""

    def frame(rows):
        return spark.createDataFrame(
            [(k, t, k, f"{k}", True, -1) for k, t in rows],
            "doc_id LONG, text STRING, n LONG, h STRING, gone BOOLEAN, n_chars LONG",
        )

    return frame
