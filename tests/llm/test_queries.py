import pytest

import __spark_entry__
from strandline.llm.queries import ORACLE_SQL, QUERIES
from tests.oracle import DATA, compare, needs_data


@needs_data
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    assert compare(spark, QUERIES[name], ORACLE_SQL[name])


@needs_data
@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_runs_over_its_table(spark, name):
    n = spark.read.parquet(f"{DATA}/documents.parquet").count()
    rows = QUERIES[name](spark, DATA).count()
    assert rows if name in ("op2_substrings", "op9_warc") else rows >= n


def test_registered():
    names = __spark_entry__.queries()
    assert {f"op{n}" for n in range(1, 11)} == {x.split("_")[0] for x in QUERIES if "_of_op" not in x} and set(QUERIES) | {"pipeline"} <= set(names)
