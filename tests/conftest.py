import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark():
    import os

    os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
    from factloom import get_spark

    session = get_spark("tests", 8, **{"spark.driver.memory": "6g", "spark.sql.shuffle.partitions": "8"})
    yield session
    session.stop()
