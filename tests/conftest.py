import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from evalspark import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = (
        session.builder("tests").master("local[4]").config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false").config("spark.driver.memory", "4g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def column(spark):
    """Values of one column expression over a list of texts (column ``x``)."""

    def values(expression, texts, schema="x string"):
        rows = [(i, *(t if isinstance(t, tuple) else (t,))) for i, t in enumerate(texts)]
        df = spark.createDataFrame(rows, f"i int, {schema}")
        return [r["v"] for r in df.select("i", expression.alias("v")).orderBy("i").collect()]

    return values
