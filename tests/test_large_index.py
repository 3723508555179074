"""Terms counted by document; postings that aren't shuffled."""

import random
from collections import Counter

from pyspark.sql import functions as F

from lexloom.functions.text import index_terms, term_counter
from lexloom.operators.index import InvertedIndex, build_index
from lexloom.options import IndexOptions
from lexloom.plans import queries


def test_term_counter(spark):
    rng = random.Random(7)
    chars = [*"abAB<>é/:;=?. \x00\t\n-0", "the ", "Of ", "İ"]
    texts = ["".join(rng.choice(chars) for _ in range(rng.randint(0, 60))) for _ in range(800)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for how in ((False, False, None), (True, False, None), (True, True, 3)):
        count = term_counter(*how)
        for r in rows.select("t", index_terms(F.col("t"), *how).alias("terms")).collect():
            assert {w.decode(): n for w, n in count(r.t.encode()).items()} == Counter(r.terms)
    assert not term_counter()(None)


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line.strip(" :+-*()0123456789") for line in plan.splitlines() if "Exchange" in line]


def test_repeated_and_null_numbers(spark):
    rows = [(1, "a", "x x y "), (1, "b", "x z "), (None, "c", "x "), (None, "d", "x "), (2, "e", None)]
    index = build_index(spark.createDataFrame(rows, "doc_idx bigint, docno string, content string").repartition(5), IndexOptions())
    assert {tuple(r) for r in index.postings.collect()} == {("x", 1, 3, 3), ("y", 1, 1, 3), ("z", 1, 1, 3), ("x", None, 2, 1)}
    assert {(r.docno, r.dl) for r in index.docs.collect()} == {("a", 3), ("b", 2), ("c", 1), ("d", 1), ("e", 0)}


def test_postings_are_not_shuffled(spark, tmp_path):
    index = queries.documents_index(spark, "/root/testdata/sf0.001")
    assert not any("term" in x for x in exchanges(index.postings))
    index.save(str(tmp_path / "i"))
    saved = InvertedIndex.load(spark, str(tmp_path / "i"))
    assert saved.postings.groupBy(F.input_file_name().alias("f"), "doc_idx").count().groupBy("doc_idx").count().where("count > 1").count() == 0
    assert len([x for x in exchanges(saved.posting_arrays())]) == 1
