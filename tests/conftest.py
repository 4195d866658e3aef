import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from indicraft.session import build_session

    session = build_session(
        "tests",
        "local[8]",
        **{"spark.driver.memory": "4g", "spark.sql.shuffle.partitions": "8", "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")), "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture(scope="session")
def sf_dir():
    return SF


@pytest.fixture
def column(spark):
    """Evaluate one Column over literal rows: column([(1,), (2,)], "x int", expr) → list."""

    def run(rows, schema, expr):
        return [r[0] for r in spark.createDataFrame(rows, schema).select(expr).collect()]

    return run
