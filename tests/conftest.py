import os
import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

from decaytrace.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(
        os.environ.get("TEST_CPUS", "4"), "decaytrace-tests",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.driver.memory": "6g",
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="decaytrace-tests-"),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def rows(df):
    return [tuple(r) for r in df.collect()]
