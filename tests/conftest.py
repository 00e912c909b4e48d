import glob
import os
import sys

import duckdb
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from fareloom.session import build_session  # noqa: E402

SAMPLE = os.environ.get("FARELOOM_SAMPLE", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = build_session("fareloom-tests", "local[4]", spark__sql__shuffle__partitions="4",
                            spark__ui__enabled="false", spark__driver__memory="4g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sample():
    return SAMPLE


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SAMPLE}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con
