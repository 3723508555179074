"""Collection files that are read by records."""

import random

import pytest
from pyspark.sql import functions as F

from lexloom.sources import trec


def random_files(rng, n):
    parts = ["<DOC>", "<DOCNO>", "</DOCNO>", "</DOC>", "<", "<D", "</DOC", "x", "y é", "\n", *["<DOC><DOCNO> 7 </DOCNO>a ß </DOC>\n"] * 6]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(1, 40))) for _ in range(n)]


def test_scanner_by_pieces():
    rng = random.Random(5)
    for text in random_files(rng, 2000):
        cuts = sorted(rng.randint(0, len(text)) for _ in range(rng.randint(0, 6)))
        pieces = [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True)]
        assert list(trec.scan_strict(pieces)) == list(trec.split_strict(text))


@pytest.fixture
def small_blocks(spark):
    held = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for k, v in zip(held, ("64", "16"), strict=True):
        spark.conf.set(k, v)
    yield
    for k, v in held.items():
        spark.conf.set(k, v)


def test_files_by_records(spark, tmp_path, small_blocks, monkeypatch):
    """Files read by records, in blocks that cut documents, give the documents of files that are read whole."""
    texts = random_files(random.Random(6), 60) + ["<DOCNO>1</DOCNO>a </DOC>" * 40, "<DOCNO>2</DOCNO>b </DOC>" * 20 + "<DOCNO>3</DOCNO>open", "", "</DOC>"]
    for i, text in enumerate(texts):
        (tmp_path / f"f{i:03d}").write_text(text, encoding="utf-8")
    want = [(d, c) for text in texts for d, c in trec.split_strict(text)]
    for most in (0, 300, 1 << 20):
        monkeypatch.setattr(trec, "WHOLE_BYTES", most)
        rows = trec.trec_documents(spark, str(tmp_path)).orderBy("doc_idx").collect()
        assert [(r.docno, r.content) for r in rows] == want
        assert [r.doc_idx for r in rows] == list(range(len(want)))
    monkeypatch.setattr(trec, "WHOLE_BYTES", 0)
    assert trec.collection_files(spark, str(tmp_path), F.col("_metadata.file_size") <= 0).rdd.getNumPartitions() <= 1  # others aren't opened
