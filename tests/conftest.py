import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark():
    from pelagia.session import local_session

    session = local_session(4, "tests", "4g", **{"spark.sql.shuffle.partitions": "4"})
    yield session
    session.stop()
