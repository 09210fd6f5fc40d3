import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from factloom.session import build_session

    os.environ.setdefault("PYTHONPATH", os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    session: SparkSession = build_session(
        master="local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false", spark__local__dir=folder, spark__checkpoint__dir=f"file://{folder}/shared", spark__sql__warehouse__dir=f"{folder}/warehouse", spark__driver__memory="4g"
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
