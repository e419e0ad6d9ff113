import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

SF_DIR = os.environ.get("HUNTLAKE_TEST_SF", "/root/testdata/sf0.01")
SMALL_SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from huntlake.session import checkpoint_dir, ensure_utc

    s = (SparkSession.builder.master("local[*]")
         .config("spark.sql.shuffle.partitions", "8")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true")
         .config("spark.driver.memory", "8g")
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    ensure_utc(s)
    checkpoint_dir(s)
    yield s


@pytest.fixture(scope="session")
def duck():
    from tests.oracle_check import duck_connection
    return duck_connection(SF_DIR)


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR
