"""A local session for all tests."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from pairloom.runtime import importable, session

    made = session("local[4]", 4, "3g")
    importable(made)
    yield made
    made.stop()
