import os
import tempfile

import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    os.environ["PYTHONPATH"] = os.path.dirname(os.path.dirname(os.path.abspath(__file__))) + ":" + os.environ.get("PYTHONPATH", "")
    with tempfile.TemporaryDirectory() as folder:
        session = (
            SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
            .config("spark.sql.warehouse.dir", f"{folder}/warehouse").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g")
            .config("spark.ui.showConsoleProgress", "false").getOrCreate()
        )
        session.sparkContext.setLogLevel("ERROR")
        yield session
        session.stop()
