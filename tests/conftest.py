import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tracegauge.plans import load_all  # noqa: E402
from tracegauge.session import local_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = local_session("4", 4, "tracegauge-tests")
    s.sparkContext.setLogLevel("OFF")
    load_all()
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return SF
