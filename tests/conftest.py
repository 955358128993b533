import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def spark():
    from talkgrid.session import local_session
    return local_session(8)


@pytest.fixture(scope="session")
def sf_dir():
    d = Path("/root/testdata/sf0.001")
    if not d.is_dir():
        pytest.skip("no driver tables here")
    return str(d)
