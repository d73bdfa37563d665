import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from adsight.plans.session import build  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build("tests", 4, partitions=4)
    yield session
    session.stop()


def day(text):
    return dt.date.fromisoformat(text)
