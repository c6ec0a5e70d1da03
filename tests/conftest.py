import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from draftlens.session import local_session  # noqa: E402

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

# Columns can only be built in a running session, so it starts with collection.
SESSION = local_session(4, "tests", "6g")


@pytest.fixture(scope="session")
def spark():
    return SESSION


@pytest.fixture(scope="session")
def data():
    return DATA


@pytest.fixture
def ev(spark):
    """Evaluate a column over one value of a text column ``t``."""

    def run(column, value, kind="string"):
        return spark.createDataFrame([(value,)], f"t {kind}").select(column.alias("v")).first()["v"]

    return run
