import json

import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    session = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture
def put(tmp_path):
    """put(path, *records): writes records as lines of JSON; strings go as they are."""

    def write(path, *records):
        file = tmp_path / path
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_text("".join((x if isinstance(x, str) else json.dumps(x)) + "\n" for x in records))
        return str(file)

    return write
