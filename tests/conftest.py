import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from bytequarry.shared import session

    made = session("4", 4, **{"spark.checkpoint.dir": tmp_path_factory.mktemp("shared").as_uri(), "spark.driver.memory": "4g"})
    yield made
    made.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"
