import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "scripts"))


@pytest.fixture(scope="session")
def spark():
    from gymlake.session import get_spark
    s = get_spark("local[*]", shuffle_partitions=8, app_name="gymlake-tests")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def tables(spark):
    from gymlake.sources.tables import Tables
    return Tables(spark, "/root/testdata/sf0.001")
