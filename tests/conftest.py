import os
import sys

import pytest

here = os.path.dirname(os.path.abspath(__file__))
sys.path[:0] = [os.path.dirname(here), here]

import helpers  # noqa: E402
from pyspark import cloudpickle  # noqa: E402

from fluoroframe.session import local_session  # noqa: E402

cloudpickle.register_pickle_by_value(helpers)


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "8g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
