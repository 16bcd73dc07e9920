import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from skein.plans.session import local_session

    return local_session("tests", cores=4, shuffle=4, memory="4g")


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"
