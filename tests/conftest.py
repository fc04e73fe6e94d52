import json
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from meterbook.session import Staging, configure  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("staging")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    yield configure(session)
    session.stop()


@pytest.fixture
def staging(spark):
    with Staging(spark, "test") as s:
        yield s


@pytest.fixture(scope="session")
def lines_of(spark):
    """Log lines from ``{path: [object or text, ...]}``; lines are numbered from 1."""

    def make(files):
        rows = [
            (path, n, v if isinstance(v, str) else json.dumps(v))
            for path, values in files.items()
            for n, v in enumerate(values, 1)
            if v != ""
        ]
        return spark.createDataFrame(rows, "file_path string, line_number bigint, value string")

    return make
