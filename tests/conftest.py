import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from citespark.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[8]",
        **{"spark.sql.shuffle.partitions": "3", "spark.python.sql.dataFrameDebugging.enabled": "false", "spark.ui.enabled": "false", "spark.driver.memory": "8g",
           "spark.sql.streaming.stateStore.providerClass":
           "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"
