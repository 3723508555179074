"""Index, scorers, sources, storage, streaming and command line on small collections."""

import random

import pytest
from pyspark.sql import functions as F

from lexloom.cli import main
from lexloom.operators.index import InvertedIndex, build_index
from lexloom.operators.rank import accumulate, run_file_name, run_lines, search, top_documents
from lexloom.operators.scoring import SCORERS, AdaptiveBm25, Bm25, TfIdf, k1_grid
from lexloom.options import IndexOptions, QueryOptions
from lexloom.sources.topics import TopicError, keywords, parse_topics, topic_lines
from lexloom.sources.trec import is_regular, split_files, split_strict, trec_documents, trec_documents_split
from lexloom.streaming.ingest import index_stream, read_segments

CORPUS = ["apple banana apple cherry", "apple apple apple apple date", "banana cherry date elder fig", "fig", "cherry cherry apple", "grape grape grape", "elder fig grape date", ""]
# topic -> scorer -> (document, score) in order: an independent single-precision evaluation of the formulas.
EXPECTED = {
    1: {"TfIdfScorer": [("D1", 1.241953), ("D5", 1.241953), ("D2", 1.115577), ("D3", 0.480453)], "BM25Scorer": [("D5", 1.088055), ("D1", 0.981644), ("D2", 0.6929389), ("D3", 0.3629078)], "BM25ADPT": [("D2", 0.7658721), ("D1", 0.7327367), ("D5", 0.6879379), ("D3", 0)]},
    2: {"TfIdfScorer": [("D6", 1.921812), ("D7", 1.921812), ("D3", 0.960906)], "BM25Scorer": [("D6", 2.999303), ("D7", 2.555121), ("D3", 0.767199)], "BM25ADPT": [("D6", 1.911577), ("D7", 1.638641), ("D3", 0)]},
    3: {"TfIdfScorer": [("D3", 0.480453), ("D4", 0.480453), ("D7", 0.480453)], "BM25Scorer": [("D4", 0.6261759), ("D7", 0.4055331), ("D3", 0.3629078)], "BM25ADPT": [("D3", 0), ("D4", 0), ("D7", 0)]},
}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, f"D{i + 1}", t + " ") for i, t in enumerate(CORPUS)], "doc_idx bigint, docno string, content string")


@pytest.fixture(scope="module")
def topics(spark):
    rows = [(1, 0, "apple", 1), (1, 1, "cherry", 1), (2, 0, "grape", 2), (2, 1, "elder", 1), (3, 0, "fig", 1), (3, 1, "zzz", 1)]
    return spark.createDataFrame(rows, "topic int, kw_pos int, term string, qtf int")


@pytest.mark.parametrize("scorer", SCORERS, ids=lambda s: s.name)
@pytest.mark.parametrize("precision", ["double", "float32"])
def test_scorers(docs, topics, scorer, precision):
    index = build_index(docs, IndexOptions())
    found = search(index, topics, scorer, digits=6, precision=precision).orderBy("topic", "rank").collect()
    for topic, by_scorer in EXPECTED.items():
        rows = [r for r in found if r.topic == topic]
        assert [r.docno for r in rows] == [d for d, _ in by_scorer[scorer.name]]
        assert [r["rank"] for r in rows] == list(range(1, len(rows) + 1))
        assert [r.score for r in rows] == pytest.approx([s for _, s in by_scorer[scorer.name]], abs=2e-6)


def test_adaptive_parameters(docs, topics):
    rows = AdaptiveBm25().term_parameters(build_index(docs, IndexOptions()), topics.select("term").distinct()).collect()
    found = {r.term: (r.df, round(r.ig1, 6), r.n_ig, round(r.k1, 4)) for r in rows}
    assert found == {"apple": (3, 0.684498, 3, 0.2), "cherry": (3, 0, 2, 0.2), "grape": (2, 0.847997, 4, 0.2), "elder": (2, 0, 2, 0.2), "fig": (3, 0, 2, 0.2)}
    assert len(k1_grid()) == 23


def test_invariants_and_storage(spark, docs, tmp_path):
    index = build_index(docs, IndexOptions(case_folding=True))
    assert index.postings.groupBy("doc_idx").agg(F.sum("tf").alias("n")).join(index.docs, "doc_idx", "right").where(F.coalesce("n", F.lit(0)) != F.col("dl")).count() == 0
    stats = index.describe()
    assert (stats.n_docs, stats.n_tokens, stats.n_terms, stats.n_postings) == (8, 25, 7, 18)
    index.save(str(tmp_path / "i"))
    index.save(str(tmp_path / "i"))
    again = InvertedIndex.load(spark, str(tmp_path / "i"))
    assert again.options == index.options
    assert sorted(again.postings.collect()) == sorted(index.postings.collect())
    half = [build_index(docs.where(c).withColumn("doc_idx", F.col("doc_idx") - o), index.options) for c, o in (("doc_idx < 4", 0), ("doc_idx >= 4", 4))]
    merged = half[0].merge(half[1])
    assert sorted(merged.postings.collect()) == sorted(index.postings.collect())
    assert sorted(merged.docs.collect()) == sorted(index.docs.collect())
    with pytest.raises(ValueError):
        index.merge(build_index(docs, IndexOptions()))
    shuffled = build_index(docs.repartition(5), index.options)
    assert sorted(shuffled.postings.collect()) == sorted(index.postings.collect())
    assert index.find_document("D3").collect()[0].doc_idx == 2 and index.find_document("x").collect()[0].doc_idx == -1


def test_empty_collection(spark, docs, topics):
    index = build_index(docs.limit(0), IndexOptions())
    assert index.corpus_stats().collect()[0].asDict() == {"n_docs": 0, "avg_dl": None}
    for scorer in SCORERS:
        assert search(index, topics, scorer).count() == 0
    assert index.merge(build_index(docs, IndexOptions())).docs.count() == 8


def test_ties_and_depth(spark):
    scores = spark.createDataFrame([(1, 5, 1.0, 1), (1, 3, 1.0, 1), (1, 9, 1.0, 0), (1, 1, 0.5, 0)], "topic int, doc_idx bigint, score double, first_kw int")
    assert [r.doc_idx for r in top_documents(scores, 3).orderBy("rank").collect()] == [9, 3, 5]
    with pytest.raises(ValueError):
        accumulate(scores, "half")


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("<DOCNO> A </DOCNO>x y \n</DOC>", [("A", "x y ")]),
        ("<DOCNO>B</DOCNO>x yz</DOC>", [("B", "x y")]),
        ("<DOCNO>C</DOCNO>open", []),
        ("<<DOCNO>D</DOCNO>x </DOC>", []),
        ("<<<DOCNO>E</DOCNO>x y </DOC>", [("E", "x y")]),
        ("<docno>F</docno>x </doc>", []),
        ("<DOCNO>G</DOCNO>a b</DOC><DOC><DOCNO>H</DOCNO>c\n</DOC>", [("G", "a "), ("H", "c")]),
        ("<DOCNO>A</DOC><DOCNO>B</DOCNO>x </DOC>", [("A</DOC><DOCNO>B", "x")]),
        ("<DO<DOCNO>A</DOCNO>x </DOC>", []),
        ("a < b << c<DOCNO>A</DOCNO>x </DOC> rest", [("A", "x")]),
        ("", []),
    ],
)
def test_trec_split(spark, text, expected):
    assert list(split_strict(text)) == expected
    files = spark.createDataFrame([("f", text)], "path string, value string")
    assert [(r.docno, r.content) for r in split_files(files).collect()] == expected
    if files.where(is_regular(F.col("value"))).count():
        assert [(r.docno, r.content) for r in split_files(files, strict=False).collect()] == expected


TOPIC_FILE = """<top>
<num> Number: 401
<title> foreign minorities, Germany
<desc> Description:
What language
<narr> Narrative:
Causes, causes
</top>
<top>
<num> Number: 402
<title> genetics
<desc> Description:
happening
<narr> Narrative:
family
</top>
"""


def terms(spark, **sections):
    rows = topic_lines(TOPIC_FILE.split("\n"), QueryOptions(**sections))
    found = keywords(spark.createDataFrame(rows, "topic int, line int, text string"), IndexOptions(case_folding=True))
    return [(r.topic, r.term, r.qtf) for r in found.orderBy("topic", "kw_pos").collect()]


def test_topic_sections(spark):
    assert terms(spark, use_headline=True) == [(401, "foreign", 1), (401, "minorities", 1), (401, "germany", 1), (402, "genetics", 1)]
    assert terms(spark, use_description=True) == [(401, "what", 1), (401, "language", 1), (402, "happening", 1)]
    assert terms(spark, use_narrative=True) == [(401, "causes", 2), (402, "genetics", 1), (402, "family", 1)]
    assert topic_lines(["<num> Number: 7", "</top>"], QueryOptions()) == [(7, 1, "")]
    with pytest.raises(TopicError):
        topic_lines(["<num> 7"], QueryOptions())


def test_run_lines(spark):
    run = spark.createDataFrame([(401, 1, "A1", 0.981644)], "topic int, rank int, docno string, score double")
    assert run_lines(run, "run-all").collect()[0].line == "401 Q0 A1 1 0.981644 run-all"
    values = [12.0, 0.0, -3.5, 1.23456789, 0.000012, 123456789.0, 100.0, 0.5]
    lines = run_lines(spark.createDataFrame([(1, i, "d", v) for i, v in enumerate(values)], "topic int, rank int, docno string, score double"), "r").orderBy("rank").collect()
    assert [x.line.split()[4] for x in lines] == ["12", "0", "-3.5", "1.234568", "1.2E-05", "1.234568E+08", "100", "0.5"]
    assert run_file_name("x", Bm25()) == "results-x-BM25Scorer.txt" and run_file_name("x", TfIdf()) == "results-x-TfIdfScorer.txt"


def test_command_line_and_files(spark, tmp_path):
    folder = tmp_path / "c" / "sub"
    folder.mkdir(parents=True)
    (folder / "one").write_text("".join(f"<DOC>\n<DOCNO> D{i + 1} </DOCNO>\n{t} \n</DOC>\n" for i, t in enumerate(CORPUS[:4])))
    (folder / "two.sgml").write_text("".join(f"<DOC>\n<DOCNO> D{i + 5} </DOCNO>\n{t} \n</DOC>\n" for i, t in enumerate(CORPUS[4:])))
    (folder / "empty").write_text("")
    found = trec_documents(spark, str(tmp_path / "c")).orderBy("doc_idx").collect()
    assert [(r.doc_idx, r.docno) for r in found] == [(i, f"D{i + 1}") for i in range(8)]
    assert sorted(r.docno for r in trec_documents_split(spark, str(tmp_path / "c")).collect()) == sorted(f"D{i + 1}" for i in range(8))
    (tmp_path / "topics").write_text(TOPIC_FILE.replace("genetics", "grape elder grape"))
    assert main([]) == 1
    assert main(["index", str(tmp_path / "c"), str(tmp_path / "index"), "IndexOptions(CaseFolding)"]) == 0
    assert main(["search", "all", str(tmp_path / "topics"), str(tmp_path / "index"), "QueryOptions(UseHeadline)", str(tmp_path / "runs")]) == 0
    written = tmp_path / "runs" / "results-all-BM25Scorer.txt"
    assert written.is_file() and not (tmp_path / "runs" / "results-all-BM25Scorer.txt.parts").exists()
    lines = written.read_text().splitlines()
    assert [x.split()[2:5] for x in lines] == [["D6", "1", "2.999303"], ["D7", "2", "2.555121"], ["D3", "3", "0.767199"]]
    assert parse_topics(spark, str(tmp_path / "topics"), QueryOptions(use_headline=True), IndexOptions(case_folding=True)).count() == 5


def test_regular_texts_split_alike(spark):
    """Random texts of tags and their parts: what passes for regular gives the strict scanner's documents."""
    rng = random.Random(4)
    parts = ["<DOC>", "<DOCNO>", "</DOCNO>", "</DOC>", "<", "<D", "<DOCN", "</DOC", "x", "y z", "\n", " 1 ", *["<DOC><DOCNO> 7 </DOCNO>a b </DOC>"] * 6]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 9))) for _ in range(3000)]
    files = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "path string, value string")
    found = {}
    for r in split_files(files).orderBy("path", "pos").collect():
        found.setdefault(r.path, []).append((r.docno, r.content))
    assert found == {str(i): list(split_strict(t)) for i, t in enumerate(texts) if list(split_strict(t))}
    native = {r.path for r in files.where(is_regular(F.col("value"))).collect()}
    assert len(native) > 300 and sum(p in native for p in found) > 20


def test_stream(spark, docs, tmp_path):
    docs.where("doc_idx < 5").write.parquet(str(tmp_path / "in"))
    source = lambda: spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in"))
    options = IndexOptions(case_folding=True)
    for more in (None, "doc_idx >= 5"):
        if more:
            docs.where(more).write.mode("append").parquet(str(tmp_path / "in"))
        index_stream(source(), str(tmp_path / "index"), str(tmp_path / "check"), options, availableNow=True).awaitTermination()
    index = read_segments(spark, str(tmp_path / "index"), options)
    whole = build_index(docs, options)
    assert sorted(index.postings.collect()) == sorted(whole.postings.collect())
    assert sorted(index.docs.collect()) == sorted(whole.docs.collect())


def test_stemming_index(spark):
    docs = spark.createDataFrame([(0, "a", "Agreed agreed happy "), (1, "b", "agree ")], "doc_idx bigint, docno string, content string")
    index = build_index(docs, IndexOptions(True, True, True))
    assert sorted(tuple(r) for r in index.postings.collect()) == [("agre", 0, 2, 3), ("agre", 1, 1, 1), ("happi", 0, 1, 3)]
