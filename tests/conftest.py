import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark():
    from evispark.session import local_session, ship

    session = ship(local_session(4, **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g"}))
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
