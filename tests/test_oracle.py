"""Every registered query against its DuckDB oracle (sf0.001), and every
query without an oracle at least runs and returns rows."""
import pytest

from rollscope.plans.catalog import ORACLE, QUERIES, load_all
from rollscope.plans.check import compare

from testdata_paths import SF001

load_all()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, duck, name):
    ok, info = compare(spark, duck, name, QUERIES[name], ORACLE[name], SF001)
    assert ok, info


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_without_oracle_runs(spark, name):
    assert QUERIES[name](spark, SF001).count() >= 0


def test_entry_smoke(spark):
    import __spark_entry__ as e
    df = e.entry(spark)
    assert df.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
