import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("stages")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sequences(spark):
    """Builder of sequence tables from (id, text) or (id, text, header)."""

    def build(rows):
        full = [(r[0], r[2] if len(r) > 2 else f">S{r[0]}.1 x", r[1], len(r[1])) for r in rows]
        return spark.createDataFrame(full, "seq_id BIGINT, header STRING, seq STRING, seq_len INT")

    return build
