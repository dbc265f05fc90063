import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from golden_rows import GOLDEN

from plantlytics.roles import Roles
from plantlytics.session import get_spark


@pytest.fixture(scope="session")
def spark():
    session = get_spark("tests", "local[8]", **{
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "6g",
    })
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def golden(spark):
    return spark.createDataFrame(GOLDEN, "row_id long, datetime timestamp_ntz, on int, ready int, kpi double")


@pytest.fixture(scope="session")
def roles():
    return Roles("datetime", "on", "ready", "row_id")
