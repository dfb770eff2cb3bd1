import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from odd_rows import CLASHING, SCHEMA, TEXTS  # noqa: E402

@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty and long texts, repeated rows and ids, and clashing columns."""
    rows = [(i, t, None if n % 4 == 0 else "en", None if n % 3 == 0 else f"s{n % 3}", n, *["clash"] * len(CLASHING)) for n, (i, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
