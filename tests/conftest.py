import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from textlens.session import build_session, release_scratch  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    conf = {
        "spark.sql.shuffle.partitions": 4,
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
        "spark.log.level": "ERROR",
    }
    session = build_session("tests", "local[8]", **conf)
    yield session
    release_scratch(session)
    session.stop()
