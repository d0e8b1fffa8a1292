from __future__ import annotations

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tools")]


@pytest.fixture(scope="session")
def spark():
    from compare import session

    return session()


@pytest.fixture(scope="session")
def small() -> str:
    return "/root/testdata/sf0.001"
