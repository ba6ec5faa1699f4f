import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from skyloom.session import session

    s = session("local[8]", 8, **{"spark.driver.memory": "10g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    yield s
    s.stop()
