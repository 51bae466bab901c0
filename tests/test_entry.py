"""Driver contract of __spark_entry__."""

import __spark_entry__ as E
from conftest import SMOKE


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "job_count" in df.columns


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


def test_rows_only_queries_run(spark):
    for name in sorted(set(E.queries()) - set(E.oracle_sql()) - set(E.LLM_QUERIES)):
        assert E.queries()[name](spark, SMOKE).count() >= 0
