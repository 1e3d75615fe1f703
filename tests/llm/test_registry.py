import re

import pytest
from compare import same

from linkspan.llm.registry import ORACLES, QUERIES


def test_ten_operators():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 11))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, small, name):
    same(spark, small, QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_one_row_for_each_row(spark, small, name):
    n = QUERIES[name](spark, small).count()
    if not name.startswith(("op5", "op10", "op1_")):
        assert n == spark.read.parquet(f"{small}/documents.parquet").count()
