import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

DATA = os.environ.get("RISKLOOM_DATA", "/root/testdata")


@pytest.fixture(scope="session")
def spark():
    from riskloom.session import local_session

    session = local_session("8", shuffle_partitions=8, app="riskloom-tests")
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def sf_small():
    return f"{DATA}/sf0.001"


@pytest.fixture
def low_floor(monkeypatch):
    """Treat groups of a few dozen rows as hot, so that small tables take the skew path."""
    monkeypatch.setattr("riskloom.operators.skew.MIN_HOT_ROWS", 40)


@pytest.fixture
def sparse_sample(monkeypatch, low_floor):
    """Find split points from a small share of the rows, as on large tables."""
    monkeypatch.setattr("riskloom.operators.skew.SAMPLES_PER_PART", 12)
    monkeypatch.setattr("riskloom.operators.skew.SAMPLES_PER_SLICE", 12)
