import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

from geoweft.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[4]", 4, **{"spark.executorEnv.PYTHONPATH": str(ROOT)})
    session.sparkContext.environment["PYTHONPATH"] = str(ROOT)
    yield session
    session.stop()
