import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_MED = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from stackrank.session import get_spark
    s = get_spark("local[4]", 8, extra_conf={"spark.driver.memory": "8g"})
    yield s
    s.stop()


@pytest.fixture(scope="session")
def ctx(spark):
    from stackrank.sources.context import context
    return context(spark, SF_SMALL)
