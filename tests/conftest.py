import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from tallyframe.session import build_session
    session = build_session("local[8]", "tests", 8, **{
        "spark.driver.memory": "6g", "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared"))})
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture
def column(spark):
    """Apply a Column builder to a list of texts, in order."""
    from pyspark.sql import functions as F

    def apply(build, values, dtype="string"):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {dtype}")
        return [r["o"] for r in df.select("i", build(F.col("x")).alias("o")).orderBy("i").collect()]
    return apply
