import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    from pagerisk.session import build_session

    session = build_session(
        "tests", f"local[{os.environ.get('TEST_CORES', 8)}]",
        **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "8g", "spark.ui.enabled": "false", "spark.log.level": "ERROR"},
    )
    yield session
    session.stop()
