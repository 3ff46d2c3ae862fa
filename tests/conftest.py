import datetime as dt
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tidemark.session import session  # noqa: E402

TOY = {
    "a": "2023-01-01",
    "b": "2023-01-01",
    "c": "2023-01-03",
    "d": "2023-01-06",
    "e": "2023-01-06",
}


@pytest.fixture(scope="session")
def spark():
    spark = session(
        "tests",
        "local[8]",
        spark__sql__shuffle__partitions="4",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    yield spark
    spark.stop()


@pytest.fixture
def toy(spark):
    rows = [(slug, dt.date.fromisoformat(day)) for slug, day in TOY.items()]
    return spark.createDataFrame(rows, "slug string, created_at date")


@pytest.fixture
def dated(spark):
    """Frame of (key, date) from a mapping of key to ISO dates."""

    def build(days_by_key):
        rows = [
            (key, dt.date.fromisoformat(day) if day else None)
            for key, days in days_by_key.items()
            for day in days
        ]
        return spark.createDataFrame(rows, "key string, at date")

    return build


def tuples(df):
    return [tuple(row) for row in df.collect()]
