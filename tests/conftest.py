import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from tallyforge.session import get_spark

    s = get_spark("tests", "local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false"})
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture(scope="session")
def sf_dir():
    path = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    if not os.path.isdir(path):
        pytest.skip("no test tables")
    return path


@pytest.fixture(scope="session")
def feeds(spark):
    rows = [("us", "America/New_York", False, "NULL"), ("eu", "Europe/Berlin", True, "k.A."), ("utc", "UTC", False, "\\N"), ("au", "Australia/Sydney", True, "-9999"), ("br", "America/Sao_Paulo", True, "n/d"), ("in", "Asia/Kolkata", True, "--"), ("uk", "Europe/London", True, "#N/A"), ("lost", None, None, None), ("odd", "No/Such_Zone", True, None)]
    return spark.createDataFrame(rows, "feed string, time_zone string, day_first boolean, null_token string")
