import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
os.environ.setdefault("QUILLMESH_DRIVER_MEMORY", "4g")


@pytest.fixture(scope="session")
def spark():
    from quillmesh.session import local_session

    session = local_session("4", 4)
    yield session
    session.stop()
