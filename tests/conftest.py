from __future__ import annotations

import pytest

from epistola.session import session


@pytest.fixture(scope="session")
def spark():
    made = session("tests", "local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g", "spark.default.parallelism": "4"})
    made.sparkContext.setLogLevel("ERROR")
    return made


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
