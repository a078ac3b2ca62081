import os

import pytest

import __spark_entry__

needs_data = pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")


def test_every_sql_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert len(__spark_entry__.queries()) >= 29


@needs_data
def test_entry_runs(spark):
    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and "severity" in df.columns
