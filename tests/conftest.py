import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
# Python workers find the package wherever the tests are started.
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH")]))


@pytest.fixture(scope="session")
def spark():
    from spendlens.session import checkpoint_dir, get_spark
    s = get_spark("local[4]", app="spendlens-tests", shuffle_partitions=4)
    s.sparkContext.setLogLevel("ERROR")
    # Tests run on one machine: the checkpoint folder is set only because it is unset.
    checkpoint_dir(s, fallback=tempfile.mkdtemp(prefix="spendlens-ckpt-", dir="/tmp"))
    yield s


SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"
