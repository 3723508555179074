"""Sums where a document lies."""

import random

import numpy as np
import pytest

from lexloom.operators.rank import accumulate
from lexloom.operators.scoring import SCORERS
from lexloom.plans import queries


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line.strip(" :+-*()0123456789") for line in plan.splitlines() if "Exchange" in line]


@pytest.mark.parametrize("scorer", SCORERS, ids=lambda s: s.name)
@pytest.mark.parametrize("precision", ["double", "float32"])
def test_sums_are_not_shuffled(spark, scorer, precision):
    """Contributions are many times the postings: only postings are dealt out, by document."""
    index = queries.saved_index(spark, "/root/testdata/sf0.001")
    scores = accumulate(scorer.contributions(index, queries.benchmark_topics(spark, "/root/testdata/sf0.001")), precision)
    found = [x for x in exchanges(scores) if "hashpartitioning(doc_idx" in x or "hashpartitioning(topic" in x]
    assert len(found) == 1 and "hashpartitioning(doc_idx" in found[0] and "REPARTITION" in found[0]


def test_single_precision_order(spark):
    """Sums in keyword order, whatever the order and parts of rows; far values tell orders apart."""
    rng = random.Random(8)
    rows = [(t, k, d, rng.choice([1e8, -1e8, 1.0, 0.1])) for t in range(5) for d in range(40) for k in rng.sample(range(9), 6)]
    rng.shuffle(rows)
    found = accumulate(spark.createDataFrame(rows, "topic int, kw_pos int, doc_idx bigint, score double").repartition(7), "float32").collect()
    want = {}
    for t, k, d, x in sorted(rows):
        total, first = want.get((t, d), (np.float32(0), k))
        want[t, d] = np.float32(total + np.float32(x)), first
    assert {(r.topic, r.doc_idx): (np.float32(r.score), r.first_kw) for r in found} == want
