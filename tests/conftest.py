import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from tarn.session import local_session

    session = local_session(4, spark__sql__shuffle__partitions="4", spark__default__parallelism="4")
    yield session
    session.stop()


@pytest.fixture
def store(spark, tmp_path):
    from tarn.sources.store import Store

    return Store(spark, str(tmp_path / "store"), buckets=4)
