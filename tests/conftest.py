import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from logweft import get_spark  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = get_spark("tests", "local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def small_chunks(monkeypatch):
    """Chunks of four positions, so that every scan crosses many of them."""
    from logweft.operators import chain, multiline, regions
    from logweft.plans import scan

    for module in (scan, regions, chain, multiline):
        monkeypatch.setattr(module, "CHUNK_BITS", 2)
