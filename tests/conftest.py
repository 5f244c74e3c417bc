import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SMALL = "/root/testdata/sf0.001"
MEDIUM = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from vigil.session import checkpoint_dir, get_session
    s = get_session("local[4]", app="vigil-tests", shuffle_partitions=8)
    s.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(s)
    yield s


class FrameInputs:
    """Hand-made catalogs for small cases: name -> DataFrame, else the fixtures."""

    def __init__(self, spark, frames, data_dir=SMALL):
        from vigil.sources.tables import FleetInputs
        self.frames = frames
        self.base = FleetInputs(spark, data_dir)

    def fx(self, name):
        name = name[3:] if name.startswith("fx_") else name
        return self.frames[name] if name in self.frames else self.base.fx(name)
