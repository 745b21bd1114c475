import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from dialoggraph.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build_session(4, app="tests", shuffle_partitions=4, driver_memory="4g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
