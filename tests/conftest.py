import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from fleetframe.session import checkpoint_dir, get_session
    scratch = tempfile.mkdtemp(prefix="fleetframe-tests-")
    session = get_session("local[4]", app="fleetframe-tests", shuffle_partitions=4,
                          extra={"spark.checkpoint.dir": os.path.join(scratch, "ckpt"),
                                 "spark.sql.warehouse.dir": os.path.join(scratch, "warehouse")})
    checkpoint_dir(session)
    yield session
    session.stop()


@pytest.fixture()
def scratch_dir():
    return tempfile.mkdtemp(prefix="fleetframe-case-")
