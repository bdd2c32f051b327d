import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from gregaria.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = tmp_path_factory.mktemp("shared")
    session = local_session(8, "tests", **{"spark.checkpoint.dir": f"file://{shared}", "spark.sql.shuffle.partitions": "2", "spark.default.parallelism": "2"})
    yield session
    session.stop()


@pytest.fixture
def rows():
    """Rows of a table as sorted tuples."""
    return lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
