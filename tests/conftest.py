import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from compare import session  # noqa: E402

from corpuskit import runtime  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    spark = session()
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    runtime.ship_package(spark)
    yield spark
    spark.stop()
