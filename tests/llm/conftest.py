"""The awkward rows as tables."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

from awkward_tables import CLASHING, awkward_rows  # noqa: E402


@pytest.fixture(scope="session")
def awkward(spark):
    schema = "doc_id long, text string, lang string, " + ", ".join(f"`{c}` string" for c in CLASHING)
    return spark.createDataFrame([(i, t, None, *(["x"] * len(CLASHING))) for i, t in awkward_rows()], schema).repartition(3)


@pytest.fixture(scope="session")
def rows():
    return awkward_rows()


@pytest.fixture(scope="session")
def nothing(awkward):
    return awkward.limit(0)
