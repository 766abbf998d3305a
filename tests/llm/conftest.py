import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

SCHEMA = "doc_id long, text string, score double, level int, block int"


@pytest.fixture
def docs(spark):
    """Rows (doc_id, text) with extra columns whose names the operators use inside."""

    def make(rows, partitions=3):
        return spark.createDataFrame([(i, t, 1.0, 2, 3) for i, t in rows], SCHEMA).repartition(partitions)

    return make


ODD = [(5, None), (6, ""), (7, " \n\t "), (8, "é漢 \U0001f600"), (9, "a"), (None, "no id"), (10, "a"), (10, "a")]


@pytest.fixture
def odd():
    """Null, empty, blank, non-ASCII and repeated rows."""
    return list(ODD)
