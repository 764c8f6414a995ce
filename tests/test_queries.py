"""Every query runs on the smallest data and equals its SQL."""

import pytest

import __spark_entry__ as entry
from compare import duck, rows_of_spark, rows_of_sql


@pytest.fixture(scope="module")
def con(small_dir):
    return duck(small_dir)


SQL = entry.oracle_sql()


def core():
    return [k for k, f in entry.queries().items() if k in SQL]


@pytest.mark.parametrize("name", core())
def test_equals_sql(spark, con, small_dir, name):
    got_cols, got = rows_of_spark(entry.queries()[name](spark, small_dir))
    want_cols, want = rows_of_sql(con, SQL[name])
    assert got_cols == want_cols
    assert got == want


@pytest.mark.parametrize("name", [k for k in entry.queries() if k not in SQL])
def test_runs(spark, small_dir, name):
    df = entry.queries()[name](spark, small_dir)
    assert df.count() >= 0 and df.columns


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_works_without_the_llm_package():
    import subprocess
    import sys

    code = "import sys; sys.modules['kbspark.llm'] = None; import __spark_entry__ as e; assert not any(k.startswith(('p1_', 'p7_')) for k in e.queries()); assert 'p5_found' in e.queries()"
    assert subprocess.run([sys.executable, "-c", code], cwd=__file__.rsplit("/", 2)[0], capture_output=True).returncode == 0
