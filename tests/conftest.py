from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from remitra.checks.inputs import workspace as open_workspace  # noqa: E402
from remitra.session import local_session  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return local_session("8", memory="6g", partitions=4)


@pytest.fixture(scope="session")
def ws(spark):
    return open_workspace(spark, FOLDER)
