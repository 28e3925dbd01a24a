import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from sluiceway import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    warehouse = tmp_path_factory.mktemp("warehouse")
    session = build_session(
        "tests",
        "local[4]",
        4,
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__sql__warehouse__dir=str(warehouse),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def people(spark):
    return spark.createDataFrame(
        [(1, "alice", 30), (2, "bob", 25), (3, "charlie", 35)], "id bigint, name string, age bigint"
    )


@pytest.fixture
def users(spark):
    return spark.createDataFrame(
        [(1, "Alice", "alice@x.org"), (2, "Bob", "bob@x.org"), (3, "Charlie", "c@x.org")],
        "id int, name string, email string",
    )


def rows(df):
    """The rows as sorted tuples."""
    return sorted((tuple(row) for row in df.collect()), key=repr)
