import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from docflow.plans.staging import clear_staging  # noqa: E402
from docflow.session import local_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, memory="4g", app="docflow-tests", **{"spark.sql.shuffle.partitions": "4"})
    yield session
    clear_staging(session)
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF
