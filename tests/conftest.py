import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import oracle_check


@pytest.fixture(scope="session")
def spark():
    from skysift.session import tune

    return tune(oracle_check.session())


@pytest.fixture(scope="session")
def con():
    return oracle_check.oracle("/root/testdata/sf0.001")


@pytest.fixture
def raster(spark):
    """(scene_id, y, x, value) rows from a list of 2-D arrays, one per scene."""
    import pandas as pd

    def make(*arrays, name="v"):
        rows = [(s, int(y), int(x), a[y, x].item()) for s, a in enumerate(arrays) for y in range(a.shape[0]) for x in range(a.shape[1])]
        pdf = pd.DataFrame(rows, columns=["scene_id", "y", "x", name]).astype({"y": "int32", "x": "int32"})
        return spark.createDataFrame(pdf)

    return make
