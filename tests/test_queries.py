"""Every retrieval query against its SQL."""

import pytest
from oracle import compare

from lexloom.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracle(spark, name):
    assert compare(spark, SF, QUERIES[name], ORACLE_SQL[name]) > 0


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_anchors(spark):
    row = QUERIES["corpus_stats"](spark, SF).collect()[0]
    assert (row.n_docs, row.avg_dl) == (200, 395.405)
    assert QUERIES["postings"](spark, SF).count() == 50296
