import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from basalt.session import session

    shared = tmp_path_factory.mktemp("shared")
    s = session("tests", "local[4]", 4, **{"spark.driver.memory": "4g", "spark.ui.enabled": "false", "spark.checkpoint.dir": f"file://{shared}", "spark.sql.warehouse.dir": f"file://{shared}/warehouse"})
    s.sparkContext.setLogLevel("ERROR")
    return s
