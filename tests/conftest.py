import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from pyspark import cloudpickle

import samples
import termloom
from termloom.session import local_session

cloudpickle.register_pickle_by_value(termloom)
cloudpickle.register_pickle_by_value(samples)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    base = tmp_path_factory.mktemp("spark")
    session = local_session(
        4,
        4,
        **{
            "spark.sql.warehouse.dir": str(base / "warehouse"),
            "spark.checkpoint.dir": str(base / "work"),
            "spark.driver.memory": "4g",
        },
    )
    yield session
    session.stop()
