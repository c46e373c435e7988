import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from utxolens.session import checkpoint_dir, local_session, ship_package

    s = local_session(cores=4, shuffle_partitions=8)
    ship_package(s)
    checkpoint_dir(s)
    yield s
    s.stop()
