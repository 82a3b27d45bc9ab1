import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from lakemart.session import session

    home = tempfile.mkdtemp(prefix="spark-lakemart-tests-")
    conf = {
        "spark.master": "local[4]", "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "4g",
        "spark.local.dir": f"{home}/local", "spark.sql.warehouse.dir": f"{home}/warehouse", "spark.checkpoint.dir": f"file://{home}/shared",
    }
    out = session("tests", **{k.replace(".", "__"): v for k, v in conf.items()})
    out.sparkContext.setLogLevel("ERROR")
    yield out
    out.stop()
