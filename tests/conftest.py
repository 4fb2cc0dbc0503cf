import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from codeloom.session import build_session
    s = build_session(master="local[2]", shuffle_partitions=4)
    yield s
    s.stop()


def files_df(spark, rows):
    """rows: (path, source) -> files(repo_id, path, source)."""
    return spark.createDataFrame([("r", p, s) for p, s in rows], "repo_id string, path string, source string")
