from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMALL_SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from profilebook.session import build_session
    s = build_session(master="local[4]", shuffle_partitions=8, app_name="profilebook-tests")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def cat(spark):
    from profilebook.registry.queries import catalog
    return catalog(spark, SMALL_SF)
