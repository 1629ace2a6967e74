import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from tabreg.session import get_spark

    # Tests set their own shared folder; the library only reads it.
    ckpt = tempfile.mkdtemp(prefix="tabreg-test-")
    s = get_spark("local[4]", app="tabreg-tests", shuffle_partitions=4, driver_memory="8g",
                  extra={"spark.checkpoint.dir": ckpt})
    yield s
    s.stop()


@pytest.fixture()
def tmp_dir():
    return tempfile.mkdtemp(prefix="tabreg-case-")
