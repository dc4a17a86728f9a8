from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from ticketlens.plans.desk import testdata_desk as make_desk  # noqa: E402
from ticketlens.session import local_session  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = f"file://{tmp_path_factory.mktemp('shared')}"
    session = local_session(8, memory="6g", partitions=4, shared=shared)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def desk(spark):
    return make_desk(spark, SF_DIR)
