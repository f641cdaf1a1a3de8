import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).resolve().parents[1]), str(Path(__file__).parent)]

from tessaline.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(cpus=8, shuffle_partitions=8)
    session.conf.set("spark.sql.adaptive.coalescePartitions.parallelismFirst", "false")
    yield session
    session.stop()
