import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tgraph.session import build_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session("8", "tests")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
    session.stop()


@pytest.fixture
def graph(spark):
    """Make an edge table from (src, tgt, t) tuples; edge_pos is the index."""

    def make(rows):
        data = [(i, *r) for i, r in enumerate(rows)]
        return spark.createDataFrame(data, "edge_pos bigint, src bigint, tgt bigint, t bigint")

    return make
