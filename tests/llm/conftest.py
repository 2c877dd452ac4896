import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
from conftest_rows import TEXTS, rows_of  # noqa: E402


@pytest.fixture(scope="session")
def odd(spark):
    return rows_of(spark, TEXTS).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return rows_of(spark, [])
