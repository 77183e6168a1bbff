from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def corpus(spark):
    """Rows and their table, with extra columns whose names the operators use inside."""
    import corpus as c

    rows = c.made()
    df = spark.createDataFrame(rows, c.SCHEMA).selectExpr("*", "1 as begins", "'x' as ends", "2 as kept", "3 as _id", "4 as rest", "5 as component_id", "6 as matches", "7 as size")
    return rows, df.repartition(3)


@pytest.fixture
def empty(spark):
    import corpus as c

    return spark.createDataFrame([], c.SCHEMA)
