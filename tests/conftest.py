import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from parcelflow.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("parcelflow-tests", "local[*]", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def column(spark):
    """Values of ``make(col('v'))`` over a list of inputs."""
    from pyspark.sql import functions as F

    def run(values, make, kind="string"):
        rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
        return [r.o for r in rows.select("i", make(F.col("v")).alias("o")).orderBy("i").collect()]

    return run
