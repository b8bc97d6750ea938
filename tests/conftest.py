import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from gridweave.session import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    options = {"spark.sql.shuffle.partitions": "3", "spark.ui.enabled": "false", "spark.driver.memory": "3g", "spark.ui.showConsoleProgress": "false"}
    spark = session("local[4]", **options)
    spark.sparkContext.setLogLevel("ERROR")
    return spark
