import pytest

import __spark_entry__
from strandline.plans.registry import ORACLE_SQL, QUERIES
from tests.oracle import compare, needs_data


@needs_data
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, name):
    n = compare(spark, QUERIES[name], ORACLE_SQL[name])
    assert n or name in ("intersect_overlap_invert_entire", "intersect_region")


@needs_data
def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["id", "chr", "start", "end", "depth"] and df.count() > 100


def test_every_query_is_registered():
    assert set(QUERIES) == set(ORACLE_SQL) and set(QUERIES) <= set(__spark_entry__.queries())
