"""Each stage on what the one before it kept, against plain versions."""

import random

import pytest
from helpers import SF, awkward, nothing, table

import corpus_pipeline as pipeline
from lexloom.llm import quality, simhash, substring

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def shingles(text, n=5):
    w = (text or "").lower().split()
    return {" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))}


def test_stages(spark, tmp_path):
    docs, kept = table(spark, "documents"), {}
    for i, (name, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, docs, SF)
        if i < 4:
            assert out.columns == COLUMNS and out.dtypes == docs.dtypes
        out.write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        kept[i] = docs.collect()
    start = table(spark, "documents").collect()
    # 1: decisions are the classifier's; clean labelled documents stay
    scores = {r.doc_id: r.score for r in quality.classify(table(spark, "documents"), table(spark, "labels")).collect()}
    assert {r.doc_id for r in kept[0]} == {d for d, s in scores.items() if s >= 0.3}
    good = {r.doc_id for r in table(spark, "labels").where("quality = 1").collect()}
    assert len(good & {r.doc_id for r in kept[0]}) >= 0.97 * len(good)
    # 2: no exact copy stays, what goes has a near copy that stays (in its component), lone documents stay
    texts = {r.doc_id: r.text for r in kept[0]}
    left = {r.doc_id for r in kept[1]}
    assert len({texts[d] for d in left}) == len(left)
    sets = {d: shingles(t) for d, t in texts.items()}
    for d in set(texts) - left:
        assert max(len(sets[d] & sets[x]) / len(sets[d] | sets[x]) for x in texts if x != d) >= 0.8
    for d in left:
        for x in left:
            assert x <= d or len(sets[d] & sets[x]) / len(sets[d] | sets[x]) < 0.8
    # 3: all documents stay, texts only lose parts, n_chars follows
    assert {r.doc_id for r in kept[2]} == left
    for r in kept[2]:
        assert len(r.text) <= len(texts[r.doc_id]) and r.n_chars == len(r.text)
    lines = [x for r in kept[2] for x in r.text.split("\n") if len(x.split()) >= substring.MIN_LINE_WORDS]
    assert len(lines) == len(set(lines))
    # 4: copies of kept rows only
    assert {r.doc_id for r in kept[3]} <= left
    # 5: every row packed
    assert sum(r.piece == 0 for r in kept[4]) == len(kept[3])
    assert start


def test_run(spark):
    assert pipeline.run(spark, SF).count() > 0


@pytest.mark.parametrize("make", [awkward, nothing])
def test_awkward_documents(spark, make, tmp_path):
    docs = make(spark)
    columns = docs.columns
    for i, (_, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, docs, SF)
        if i < 4:
            assert out.columns == columns
        out.write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
    assert (docs.count() == 0) == (make is nothing)


def test_near_copies_go(spark):
    rng = random.Random(8)
    words = [[f"v{rng.randrange(5000)}" for _ in range(200)] for _ in range(40)]
    rows = [(i, " ".join(w)) for i, w in enumerate(words)] + [(100 + i, " ".join([*w[:90], "changed", *w[91:]])) for i, w in enumerate(words)]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted(r.doc_id for r in kept) == list(range(40))
