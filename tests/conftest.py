import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from lexarium.session import local  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local(4, "4g")
