from __future__ import annotations

import os
import uuid
from pathlib import Path

import pytest

from contexture.session import build_session

TESTDATA = Path(os.environ.get("TESTDATA_DIR", "/root/testdata"))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "contexture-tests",
        master="local[4]",
        conf={
            "spark.ui.enabled": "false",
            "spark.sql.shuffle.partitions": "4",
            "spark.default.parallelism": "4",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
            "spark.driver.memory": "4g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def folder(tmp_path):
    """A fresh path per call."""
    return lambda name: str(tmp_path / f"{name}-{uuid.uuid4().hex[:8]}")


@pytest.fixture
def check_plan(spark):
    """Physical plan of a DataFrame as text."""

    def plan(df) -> str:
        return df._jdf.queryExecution().executedPlan().toString()

    return plan
