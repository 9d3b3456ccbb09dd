import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from crawlsight.session import build_session

    shared = tmp_path_factory.mktemp("shared")
    session = build_session("tests", "local[8]", **{
        "spark.sql.shuffle.partitions": 4, "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g",
        "spark.checkpoint.dir": f"file://{shared}/checkpoints",
        "spark.sql.warehouse.dir": f"file://{shared}/warehouse"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def folder(tmp_path):
    return str(tmp_path)
