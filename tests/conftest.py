import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from codeset_engine.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[8]", 8, spark__driver__memory="8g",
                            spark__ui__enabled="false")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
