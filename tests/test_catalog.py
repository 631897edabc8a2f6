"""A choice of registered queries next to their SQL at the smallest scale.

``tools/check.py`` compares all of them.
"""

import sys

import duckdb
import pytest
from conftest import SF

import __spark_entry__ as entry

sys.path.insert(0, "tools")
from tools.check import TABLES, compare  # noqa: E402

CHOICE = (
    "canonical_dedup reindex_nodes quantile_split snap_time snap_cumulative compute_metrics latency_profile "
    "inject_clique inject_structural negatives_degree recent_neighbors snapshot_props drnl edge_context "
    "biased_walks tfidf deviation_score"
).split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", CHOICE)
def test_query_equals_sql(spark, db, name):
    got = entry.queries()[name](spark, SF).toPandas()
    verdict = compare(got, db.execute(entry.oracle_sql()[name]).df())
    assert verdict.startswith("ok"), verdict


def test_entry_and_registry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
