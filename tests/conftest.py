import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from ledgerline.session import checkpoint_dir

    s = (SparkSession.builder.master("local[*]")
         .config("spark.sql.shuffle.partitions", "8")
         .config("spark.ui.enabled", "false")
         # one session for all tests: room for its plans, and few of them kept
         .config("spark.driver.memory", "8g")
         .config("spark.sql.ui.retainedExecutions", "5")
         .config("spark.ui.retainedJobs", "20")
         .config("spark.ui.retainedStages", "20")
         .config("spark.ui.retainedTasks", "200")
         .config("spark.sql.session.timeZone", "UTC")
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(s)
    yield s


@pytest.fixture(scope="session")
def sf_dir():
    return SF_SMALL
