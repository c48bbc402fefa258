import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
from sql_compare import same

from inkwell.plans.oracle import ORACLE_SQL
from inkwell.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLE_SQL:
        same(df, ORACLE_SQL[name], SF)
    assert df.count()


def test_all_sql_belongs_to_a_query():
    assert set(ORACLE_SQL) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count()
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
