import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from supplyscope.session import local_session  # noqa: E402
from supplyscope.sources.schemas import SPECS, frame  # noqa: E402
from supplyscope.sources.tables import LazyTables  # noqa: E402

SF0001 = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, shuffle_partitions=4, app="supplyscope-tests")
    yield s


@pytest.fixture
def ebs(spark):
    """Factory: report source tables with the given rows, every other table empty."""

    def make(**rows):
        unknown = set(rows) - set(SPECS)
        assert not unknown, unknown
        return LazyTables({name: (lambda name=name: frame(spark, name, rows.get(name))) for name in SPECS})

    return make
