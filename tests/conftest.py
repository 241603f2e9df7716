import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from maskwright.session import local_session, ship_package

    session = local_session(8, "tests", **{"spark.sql.shuffle.partitions": "8"})
    ship_package(session)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    return DATA


@pytest.fixture(scope="session")
def duck(data):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for name in os.listdir(data):
        con.execute(f"create view {name.split('.')[0]} as select * from '{data}/{name}'")
    return con
