import tempfile

import pytest
from pyspark.sql import SparkSession

from auditlake.shipping import ship


@pytest.fixture(scope="session")
def spark():
    conf = {"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC"}
    conf |= {"spark.driver.memory": "4g", "spark.local.dir": tempfile.mkdtemp(prefix="spark-"), "spark.sql.warehouse.dir": tempfile.mkdtemp(prefix="spark-")}
    conf |= {"spark.checkpoint.dir": "file://" + tempfile.mkdtemp(prefix="spark-")}
    s = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    ship(s)
    return s
