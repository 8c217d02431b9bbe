from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from plumbline.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        app="tests", master="local[8]", spark_sql_shuffle_partitions="8", spark_driver_memory="8g", spark_ui_enabled="false"
    )
    session.sparkContext.setLogLevel("ERROR")
    return session
