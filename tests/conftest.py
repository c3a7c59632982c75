import os

import pytest

from siltstone.session import local_session

DATA = os.environ.get("SILTSTONE_TESTDATA", "/root/testdata")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(4, 4, "3g")
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    """The folder of the smallest test tables."""
    return f"{DATA}/sf0.001"
