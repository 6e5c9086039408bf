import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from postweave.schema import POSTS  # noqa: E402
from tests.spark_session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("4")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_posts(spark):
    """Posts from dicts; columns left out get defaults, ids count from 1."""

    def make(*rows: dict):
        filled = []
        for number, row in enumerate(rows, 1):
            base = {
                "status_id": str(number),
                "created_at": dt.datetime(2024, 1, 1),
                "screen_name": "someone",
                "text": "",
                "is_quote": False,
                "is_retweet": False,
                "favorite_count": 0,
                "retweet_count": 0,
                "followers_count": 0,
            }
            base.update(row)
            filled.append(tuple(base[field.name] for field in POSTS))
        return spark.createDataFrame(filled, POSTS)

    return make


@pytest.fixture(scope="session")
def rows_of():
    def rows(df, *columns):
        return sorted(tuple(row) for row in df.select(*(columns or df.columns)).collect())

    return rows
