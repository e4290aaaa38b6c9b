import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tapewatch.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session("tests", "local[8]", **{
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("staged")),
        "spark.sql.shuffle.partitions": "4", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false",
        "spark.sql.maxMetadataStringLength": "10000"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def salted(monkeypatch):
    """Treat every lookup table as too large to broadcast."""
    from tapewatch.operators import joins
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 0)
