import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).resolve().parents[1]), str(Path(__file__).resolve().parent)]

from stratafold.session import local_session  # noqa: E402

TESTDATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    scratch = str(tmp_path_factory.mktemp("scratch"))
    warehouse = str(tmp_path_factory.mktemp("warehouse"))
    settings = {"spark.checkpoint.dir": scratch, "spark.sql.warehouse.dir": warehouse}
    session = local_session(4, "tests", **{**settings, "spark.sql.shuffle.partitions": "4"})
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tiny():
    return f"{TESTDATA}/sf0.001"


@pytest.fixture(scope="session")
def small():
    return f"{TESTDATA}/sf0.01"
