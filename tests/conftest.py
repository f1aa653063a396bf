import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from flowgauge.session import build_session
    s = build_session("local[8]", 8, extra={"spark.ui.showConsoleProgress": "false",
                                            "spark.driver.memory": "8g"})
    yield s
    s.stop()
