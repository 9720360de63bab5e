import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession
    from draftkit.session import DEFAULT_CONF
    b = SparkSession.builder.master("local[4]").appName("draftkit-tests")
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = "8"
    for k, v in conf.items():
        b = b.config(k, v)
    s = b.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    if not s.sparkContext.getCheckpointDir():
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="draftkit-test-ckpt-"))
    yield s
    s.stop()
