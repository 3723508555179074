"""The registered queries of the retrieval engine, each with the SQL that DuckDB runs on the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions.stemming import stem_udf, stem_vocabulary
from lexloom.functions.text import BENCH_STOP_WORDS, STOP_WORDS, fold_ascii, index_words
from lexloom.operators.index import InvertedIndex, build_index
from lexloom.operators.membership import count_members
from lexloom.operators.rank import run_lines, search
from lexloom.operators.scoring import AdaptiveBm25, Bm25, TfIdf
from lexloom.options import IndexOptions, QueryOptions
from lexloom.sources.topics import keywords, parse_topics, table_topics, topic_lines
from lexloom.sources.trec import split_files, table_documents, trec_documents
from lexloom.storage import scratch_path, spread, version_of

FOLD = IndexOptions(case_folding=True)
TOP = 1000
#: Documents that a stop-word candidate occurs in, at the scale of these tables.
CANDIDATE_THRESHOLD = 50


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents_index(spark: SparkSession, sf_dir: str, options: IndexOptions = FOLD) -> InvertedIndex:
    """The index of documents, made from their texts whenever it is used."""
    return build_index(table_documents(spread(_table(spark, sf_dir, "documents")), "doc_id", "text"), options)


#: Saved indexes of this process: (application, table, its version, options) -> folder.
_SAVED: dict[tuple, str] = {}


def saved_index(spark: SparkSession, sf_dir: str, options: IndexOptions = FOLD) -> InvertedIndex:
    """The index of documents from the shared folder: built and saved by the first query that asks for it, then searched by all."""
    table = f"{sf_dir}/documents.parquet"
    key = (spark.sparkContext.applicationId, table, version_of(spark, table), options)
    if key not in _SAVED:
        path = scratch_path(spark, "index")
        documents_index(spark, sf_dir, options).save(path)
        _SAVED[key] = path
    return InvertedIndex.load(spark, _SAVED[key])


def benchmark_topics(spark: SparkSession, sf_dir: str, options: IndexOptions = FOLD) -> DataFrame:
    return table_topics(_table(spark, sf_dir, "benchmark"), "item_id", "text", options)


# ---- SQL pieces ------------------------------------------------------------------------------------------------

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words_sql(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


def tokens_sql(table: str = "documents", key: str = "doc_id", text: str = "text", fold: bool = True, stop: bool = False) -> str:
    """SELECT key, w: one row per word."""
    w = f"translate(w, '{_UPPER}', '{_LOWER}')" if fold else "w"
    cut = f"SELECT {key}, unnest(a[1:len(a)-1]) AS w FROM (SELECT {key}, string_split_regex({text}, '[\\x00-\\x2f:;=?]') AS a FROM {table})"
    kept = f"SELECT {key}, {w} AS w FROM ({cut}) WHERE w <> '' AND NOT starts_with(w, '<') AND NOT ends_with(w, '>')"
    return f"SELECT * FROM ({kept}) WHERE w NOT IN ({_words_sql(STOP_WORDS)})" if stop else kept


INDEX_SQL = f"""
tok AS ({tokens_sql()}),
post AS (SELECT w AS term, doc_id, count(*)::INT AS tf FROM tok GROUP BY 1, 2),
df AS (SELECT term, count(*) AS df FROM post GROUP BY 1),
dl AS (SELECT d.doc_id, coalesce(n, 0)::BIGINT AS dl FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n FROM tok GROUP BY 1) USING (doc_id)),
meta AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl)"""

TOPIC_SQL = """
words AS (SELECT item_id::INT AS topic, unnest(a) AS w, generate_subscripts(a, 1) AS pos FROM (SELECT item_id, string_split_regex(text, '[, .();:?/]') AS a FROM benchmark)),
kw AS (SELECT topic, lower(w) AS term, min(pos) AS pos, count(*)::INT AS qtf FROM words WHERE trim(regexp_replace(w, '\\s', ' ', 'g')) <> '' AND NOT starts_with(w, '<') GROUP BY 1, 2),
topics AS (SELECT topic, (row_number() OVER (PARTITION BY topic ORDER BY pos) - 1)::INT AS kw_pos, term, qtf FROM kw)"""

MATCHED_SQL = "m AS (SELECT t.topic, t.kw_pos, t.term, t.qtf, df.df, p.doc_id, p.tf, dl.dl, meta.n, meta.avgdl FROM topics t JOIN post p USING (term) JOIN df USING (term) JOIN dl ON dl.doc_id = p.doc_id, meta)"


def _top_sql(score: str, source: str = "m", summed: str = "sum(x)") -> str:
    return f"""
s AS (SELECT topic, doc_id, round({summed}, 4) AS score, min(kw_pos) AS first_kw FROM (SELECT topic, kw_pos, doc_id, {score} AS x FROM {source}) GROUP BY 1, 2),
r AS (SELECT topic, (row_number() OVER (PARTITION BY topic ORDER BY score DESC, first_kw, doc_id))::INT AS rank, doc_id::VARCHAR AS docno, score FROM s)
SELECT topic, rank, docno, score FROM r WHERE rank <= {TOP}"""


_TFIDF = "ln(1 + tf) * ln((n // df)::DOUBLE)"
_BM25 = "ln((n::DOUBLE - df + 0.5e0) / (df + 0.5e0)) * (tf * 2.2e0 / (tf + 1.2e0 * (0.25e0 + 0.75e0 * (dl / avgdl)))) * (101e0 * qtf / (100e0 + qtf))"

_GRID = ", ".join(f"{j!r}::DOUBLE" for j in __import__("lexloom.operators.scoring", fromlist=["k1_grid"]).k1_grid())
PARAMS_SQL = f"""
qterm AS (SELECT DISTINCT term FROM topics),
cd AS (SELECT p.term, p.doc_id, (p.tf / (0.25e0 + 0.75e0 * dl.dl / meta.avgdl))::FLOAT AS c FROM post p JOIN qterm USING (term) JOIN dl ON dl.doc_id = p.doc_id, meta),
hist AS (SELECT term, least(floor(c::DOUBLE + 0.5e0), 101)::INT AS t, count(*) AS n FROM cd GROUP BY 1, 2),
tot AS (SELECT term, sum(n)::BIGINT AS df FROM hist GROUP BY 1),
grid AS (SELECT term, df, unnest(range(0, 101)) AS t FROM tot),
cnt AS (SELECT g.term, g.df, g.t, CASE WHEN g.t = 0 THEN (SELECT n FROM meta) WHEN g.t = 1 THEN g.df ELSE sum(CASE WHEN h.t >= g.t THEN h.n ELSE 0 END) END::BIGINT AS d FROM grid g JOIN hist h USING (term) GROUP BY g.term, g.df, g.t),
nx AS (SELECT *, lead(d) OVER (PARTITION BY term ORDER BY t) AS d1 FROM cnt),
ig AS (SELECT term, df, t, (-log2((df + 0.5e0) / ((SELECT n FROM meta) + 1)) + log2((d1 + 0.5e0) / (d + 1)))::FLOAT AS ig FROM nx WHERE t <= 99),
lg AS (SELECT *, lag(ig) OVER (PARTITION BY term ORDER BY t) AS p FROM ig),
ct AS (SELECT *, min(CASE WHEN p > ig THEN t END) OVER (PARTITION BY term) AS cut FROM lg),
se AS (SELECT term, df, t, CASE WHEN t = cut THEN 0::FLOAT ELSE ig END AS ig FROM ct WHERE cut IS NULL OR t <= cut),
fi AS (SELECT *, max(CASE WHEN t = 1 THEN ig END) OVER (PARTITION BY term) AS ig1, count(*) OVER (PARTITION BY term) AS n_ig FROM se),
er AS (SELECT term, df, ig1, n_ig, j, sum(pow((CASE WHEN ig1 <> 0 THEN (ig::DOUBLE / ig1::DOUBLE)::FLOAT::DOUBLE END) - (j + 1) * t / (j + t), 2)) AS e FROM fi, (SELECT unnest([{_GRID}]) AS j) GROUP BY 1, 2, 3, 4, 5),
params AS (SELECT term, df, ig1, n_ig::INT AS n_ig, j::FLOAT AS k1 FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY coalesce(e, 0e0), j) AS o FROM er) WHERE o = 1)"""


# ---- queries ---------------------------------------------------------------------------------------------------

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query(f"SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_tokens FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n FROM ({tokens_sql(fold=False)}) GROUP BY 1) USING (doc_id)")
def tokenize_counts(spark, sf_dir):
    return spread(_table(spark, sf_dir, "documents")).select("doc_id", F.size(index_words(F.col("text"))).cast("bigint").alias("n_tokens"))


@query(f"SELECT page_id, w AS term, count(*) AS n FROM ({tokens_sql('pages', 'page_id', 'html', fold=False)}) GROUP BY 1, 2")
def tokenize_pages_tags(spark, sf_dir):
    words = _table(spark, sf_dir, "pages").select("page_id", F.explode(index_words(F.col("html"))).alias("term"))
    return words.groupBy("page_id", "term").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT d.doc_id, coalesce(n, 0)::BIGINT AS dl FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n FROM ({tokens_sql(stop=True)}) GROUP BY 1) USING (doc_id)")
def stopword_filter_counts(spark, sf_dir):
    index = documents_index(spark, sf_dir, IndexOptions(case_folding=True, remove_stop_words=True))
    return index.docs.select(F.col("doc_idx").alias("doc_id"), "dl")


@query(f"SELECT w AS term, doc_id AS doc_idx, count(*)::INT AS tf FROM ({tokens_sql()}) GROUP BY 1, 2")
def postings(spark, sf_dir):
    return documents_index(spark, sf_dir).postings.select("term", "doc_idx", "tf")


@query(f"SELECT w AS term, doc_id // 1048576 AS block, list(struct_pack(doc_idx := doc_id, tf := tf) ORDER BY doc_id)::VARCHAR AS postings FROM (SELECT w, doc_id, count(*)::INT AS tf FROM ({tokens_sql()}) GROUP BY 1, 2) GROUP BY 1, 2")
def posting_arrays(spark, sf_dir):
    arrays = saved_index(spark, sf_dir).posting_arrays()
    one = F.transform("postings", lambda p: F.concat(F.lit("{'doc_idx': "), p["doc_idx"].cast("string"), F.lit(", 'tf': "), p["tf"].cast("string"), F.lit("}")))
    return arrays.select("term", "block", F.concat(F.lit("["), F.array_join(one, ", "), F.lit("]")).alias("postings"))


@query(f"WITH {INDEX_SQL} SELECT term, df FROM df")
def doc_frequency(spark, sf_dir):
    return saved_index(spark, sf_dir).term_stats()


@query(f"WITH {INDEX_SQL} SELECT doc_id AS doc_idx, doc_id::VARCHAR AS docno, dl FROM dl")
def doc_length(spark, sf_dir):
    return documents_index(spark, sf_dir).docs


@query(f"WITH {INDEX_SQL} SELECT n AS n_docs, round(avgdl, 6) AS avg_dl FROM meta")
def corpus_stats(spark, sf_dir):
    return saved_index(spark, sf_dir).corpus_stats().select("n_docs", F.round("avg_dl", 6).alias("avg_dl"))


@query(f"WITH {INDEX_SQL} SELECT length(term)::INT AS term_length, count(*) AS n_terms FROM df GROUP BY 1 ORDER BY 1 DESC LIMIT 100")
def term_length_histogram(spark, sf_dir):
    return saved_index(spark, sf_dir).term_length_histogram()


@query(f"WITH {INDEX_SQL} SELECT df, count(*) AS n_terms FROM df GROUP BY 1 ORDER BY 1 LIMIT 100")
def posting_length_histogram(spark, sf_dir):
    return saved_index(spark, sf_dir).posting_length_histogram()


@query(f"WITH {INDEX_SQL} SELECT term, df FROM df WHERE df > {CANDIDATE_THRESHOLD} AND length(term) <= 4")
def stopword_candidates(spark, sf_dir):
    return saved_index(spark, sf_dir).stop_word_candidates(CANDIDATE_THRESHOLD)


@query(f"SELECT w AS term, doc_id AS doc_idx, count(*)::INT AS tf FROM ({tokens_sql()} UNION ALL SELECT item_id + (SELECT max(doc_id) + 1 FROM documents), w FROM ({tokens_sql('benchmark', 'item_id')})) GROUP BY 1, 2")
def index_merge(spark, sf_dir):
    other = build_index(table_documents(_table(spark, sf_dir, "benchmark"), "item_id", "text"), FOLD)
    return documents_index(spark, sf_dir).merge(other).postings.select("term", "doc_idx", "tf")


@query(f"WITH {INDEX_SQL} SELECT term, doc_id AS doc_idx, tf, dl FROM post JOIN dl USING (doc_id)")
def index_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "index")
    documents_index(spark, sf_dir).save(path)
    index = InvertedIndex.load(spark, path)
    return index.postings.select("term", "doc_idx", "tf", "dl")


@query("SELECT x AS docno, coalesce((SELECT min(doc_id) FROM documents WHERE doc_id::VARCHAR = x), -1)::BIGINT AS doc_idx FROM (VALUES ('17'), ('no such document')) v(x)")
def doc_lookup(spark, sf_dir):
    index = saved_index(spark, sf_dir)
    found = [index.find_document(name).select(F.lit(name).alias("docno"), "doc_idx") for name in ("17", "no such document")]
    return found[0].unionByName(found[1])


@query(f"WITH {INDEX_SQL} SELECT k.kw_pos::INT AS kw_pos, p.term, p.doc_id AS doc_idx, p.tf FROM post p JOIN (VALUES (0, 'the'), (1, 'zzzz'), (2, 'license')) k(kw_pos, term) USING (term)")
def posting_lookup(spark, sf_dir):
    terms = spark.createDataFrame([(0, "the"), (1, "zzzz"), (2, "license")], "kw_pos int, term string")
    return saved_index(spark, sf_dir).posting_lists(terms)


_TREC_SQL = "SELECT doc_id::VARCHAR AS docno, chr(10) || text AS content FROM documents"


def _as_trec(spark, sf_dir) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").cast("string").alias("path"), F.concat(F.lit("<DOC>\n<DOCNO> "), F.col("doc_id").cast("string"), F.lit(" </DOCNO>\n"), F.col("text"), F.lit("\n</DOC>\n")).alias("value"))


@query(_TREC_SQL)
def trec_split(spark, sf_dir):
    return split_files(_as_trec(spark, sf_dir), strict=False).select("docno", "content")


@query(_TREC_SQL)
def trec_split_strict(spark, sf_dir):
    return split_files(_as_trec(spark, sf_dir), strict=True).select("docno", "content")


@query("SELECT (row_number() OVER (ORDER BY doc_id % 7, doc_id) - 1)::BIGINT AS doc_idx, doc_id::VARCHAR AS docno, chr(10) || text AS content FROM documents")
def collection_scan(spark, sf_dir):
    """documents written as seven folders of collection files, and read back in the order of files and places. Each folder
    holds the files of its ranges of documents, whose names follow their order."""
    path = scratch_path(spark, "collection")
    docs = _table(spark, sf_dir, "documents").withColumn("file", F.col("doc_id") % 7)
    whole = F.concat(F.lit("<DOC>\n<DOCNO> "), F.col("doc_id").cast("string"), F.lit(" </DOCNO>\n"), F.col("text"), F.lit("\n</DOC>"))
    lines = docs.select("file", "doc_id", whole.alias("value")).repartitionByRange("file", "doc_id").sortWithinPartitions("file", "doc_id")
    lines.select("file", "value").write.partitionBy("file").text(path)
    return trec_documents(spark, path)


def _topic_text(rows: list[tuple[int, str]]) -> str:
    return "".join(f"<top>\n<num> Number: {topic}\n<title> {text}\n</top>\n" for topic, text in rows)


@query("SELECT * FROM (VALUES (7::INT, 0::INT, 'licence', 2::INT), (7, 1, 'text', 1), (8, 0, 'gene', 1), (8, 1, 'pages', 1)) v(topic, kw_pos, term, qtf)")
def topic_file(spark, sf_dir):
    """A topic file written to the shared folder and read back, stop words kept out."""
    path = scratch_path(spark, "topics")
    lines = _topic_text([(7, "The licence, licence of a TEXT"), (8, "gene pages")]).split("\n")
    spark.createDataFrame(list(enumerate(lines)), "i int, value string").coalesce(1).sortWithinPartitions("i").select("value").write.text(path)
    return parse_topics(spark, path, QueryOptions(use_headline=True), IndexOptions(case_folding=True, remove_stop_words=True))


@query(f"WITH {TOPIC_SQL}, kept AS (SELECT * FROM topics WHERE term NOT IN ({_words_sql(STOP_WORDS)})) SELECT topic, (row_number() OVER (PARTITION BY topic ORDER BY kw_pos) - 1)::INT AS kw_pos, term, qtf FROM kept")
def topic_keywords_without_stop_words(spark, sf_dir):
    return benchmark_topics(spark, sf_dir, IndexOptions(case_folding=True, remove_stop_words=True))


@query("SELECT * FROM (VALUES ('QueryOptions(UseHeadline)', true, false, false), ('QueryOptions(UseHeadline,UseNarrative)', true, false, true), ('QueryOptions(UseDescription)', false, true, false), ('QueryOptions()', false, false, false)) v(text, use_headline, use_description, use_narrative)")
def query_options_parse(spark, sf_dir):
    texts = ("QueryOptions(UseHeadline)", "QueryOptions(UseHeadline,UseNarrative)", "QueryOptions(UseDescription)", "QueryOptions()")
    rows = [(t, o.use_headline, o.use_description, o.use_narrative) for t in texts for o in [QueryOptions.parse(t)]]
    return spark.createDataFrame(rows, "text string, use_headline boolean, use_description boolean, use_narrative boolean")


@query(f"WITH {TOPIC_SQL} SELECT topic, kw_pos, term, qtf FROM topics")
def topic_keywords(spark, sf_dir):
    return benchmark_topics(spark, sf_dir)


SAMPLE_TOPICS = """<top>

<num> Number: 401
<title> foreign minorities, Germany

<desc> Description:
What language differences impede integration?

<narr> Narrative:
Relevant, relevant causes.

</top>
<top>
<num> Number: 402
<title> behavioral genetics
<desc> Description:
What is happening?
<narr> Narrative:
Family causes.
</top>"""


@query("SELECT * FROM (VALUES (401::INT, 0::INT, 'relevant', 2::INT), (401, 1, 'causes', 1), (402, 0, 'behavioral', 1), (402, 1, 'genetics', 1), (402, 2, 'family', 1), (402, 3, 'causes', 1)) v(topic, kw_pos, term, qtf)")
def topic_parse_sections(spark, sf_dir):
    """Narratives only: the second topic's title line falls into the section that the first one left open."""
    rows = topic_lines(SAMPLE_TOPICS.split("\n"), QueryOptions(use_narrative=True))
    return keywords(spark.createDataFrame(rows, "topic int, line int, text string"), FOLD)


@query(f"WITH {INDEX_SQL}, {TOPIC_SQL}, {MATCHED_SQL}, {_top_sql(_TFIDF)}")
def tfidf_topk(spark, sf_dir):
    return search(saved_index(spark, sf_dir), benchmark_topics(spark, sf_dir), TfIdf(), TOP, digits=4)


@query(f"WITH {INDEX_SQL}, {TOPIC_SQL}, {MATCHED_SQL}, {_top_sql(_TFIDF, summed='list_reduce(list_prepend(0::FLOAT, list(x::FLOAT ORDER BY kw_pos)), lambda a, b: (a + b)::FLOAT)::DOUBLE')}")
def tfidf_topk_float32(spark, sf_dir):
    """Single-precision sums in keyword order."""
    from lexloom.operators.rank import accumulate, top_documents

    index = saved_index(spark, sf_dir)
    scores = accumulate(TfIdf().contributions(index, benchmark_topics(spark, sf_dir)), "float32")
    best = top_documents(scores.withColumn("score", F.col("score").cast("double")), TOP, 4)
    return best.select("topic", "rank", F.col("doc_idx").cast("string").alias("docno"), "score")


@query(f"WITH {INDEX_SQL}, {TOPIC_SQL}, {MATCHED_SQL}, {_top_sql(_BM25)}")
def bm25_topk(spark, sf_dir):
    return search(saved_index(spark, sf_dir), benchmark_topics(spark, sf_dir), Bm25(), TOP, digits=4)


@query(f"WITH {INDEX_SQL}, {TOPIC_SQL}, {PARAMS_SQL} SELECT term, df, round(ig1::DOUBLE, 5) AS ig1, n_ig, round(k1::DOUBLE, 4) AS k1 FROM params")
def bm25_adaptive_params(spark, sf_dir):
    found = AdaptiveBm25().term_parameters(saved_index(spark, sf_dir), benchmark_topics(spark, sf_dir).select("term").distinct())
    return found.select("term", "df", F.round(F.col("ig1").cast("double"), 5).alias("ig1"), "n_ig", F.round(F.col("k1").cast("double"), 4).alias("k1"))


_ADPT = "(qtf::FLOAT * ((c * (k1 + 1::FLOAT))::FLOAT / (k1 + c)::FLOAT)::FLOAT * ig1)::FLOAT::DOUBLE"


@query(f"WITH {INDEX_SQL}, {TOPIC_SQL}, {PARAMS_SQL}, ma AS (SELECT t.topic, t.kw_pos, t.qtf, cd.doc_id, cd.c, params.k1, params.ig1 FROM topics t JOIN params USING (term) JOIN cd USING (term)), {_top_sql(_ADPT, 'ma')}")
def bm25_adaptive_topk(spark, sf_dir):
    return search(saved_index(spark, sf_dir), benchmark_topics(spark, sf_dir), AdaptiveBm25(), TOP, digits=4)


# Words and stems traced by hand.
STEMS = {"hoping": "hop", "filing": "fil", "mating": "mate", "disabled": "disabl", "agreed": "agre", "entering": "ent", "ies": "i", "yes": "ye", "happy": "happi", "sky": "sky", "is": "is", "ed": "ed"}


@query("SELECT * FROM (VALUES " + ", ".join(f"('{w}', '{s}')" for w, s in STEMS.items()) + ") v(term, stem)")
def stem_golden(spark, sf_dir):
    words = spark.createDataFrame([(w,) for w in STEMS], "term string")
    return words.select("term", stem_udf()(F.col("term")).alias("stem"))


@query()
def stem_vocabulary_documents(spark, sf_dir):
    """Every distinct term of documents with its stem."""
    words = _table(spark, sf_dir, "documents").select(F.explode(index_words(F.col("text"))).alias("w")).select(fold_ascii(F.col("w")).alias("term"))
    return stem_vocabulary(words)


@query()
def bm25_stemmed_topk(spark, sf_dir):
    options = IndexOptions(case_folding=True, remove_stop_words=True, do_stemming=True)
    return search(saved_index(spark, sf_dir, options), benchmark_topics(spark, sf_dir, options), Bm25(), TOP, digits=4)


def _bench(n: int) -> None:
    words = BENCH_STOP_WORDS[:n]
    counted = f"SELECT count(*) AS n FROM ({tokens_sql()}) WHERE w IN ({_words_sql(words)})"
    names = "('hash_set'), ('comparisons'), ('sorted_array'), ('map'), ('semi_join'), ('grouping')"

    def run(spark, sf_dir):
        docs = spread(_table(spark, sf_dir, "documents"))
        return count_members(docs.select(F.explode(index_words(F.col("text"))).alias("w")).select(fold_ascii(F.col("w")).alias("term")), words)

    run.__name__ = f"stopword_bench_{n}"
    query(f"SELECT method, n::BIGINT AS n FROM (VALUES {names}) v(method), ({counted})")(run)


for _n in (10, 20, 50):
    _bench(_n)


@query(f"WITH {INDEX_SQL}, {TOPIC_SQL}, {MATCHED_SQL}, {_top_sql(_BM25).replace('SELECT topic, rank, docno, score FROM r', chr(10) + 'SELECT topic, rank, topic || ' + repr(' Q0 ') + ' || docno || ' + repr(' ') + ' || rank || ' + repr(' ') + ' || printf(' + repr('%.4f') + ', score) || ' + repr(' run-all') + ' AS line FROM r')}")
def trec_run_lines(spark, sf_dir):
    return run_lines(bm25_topk(spark, sf_dir), "run-all", "%.4f")


@query("SELECT * FROM (VALUES ('IndexOptions(CaseFolding)', true, false, false), ('IndexOptions(CaseFolding, DoStemming)', true, false, false), ('IndexOptions(CaseFolding,RemoveStopWords,DoStemming)', true, true, true), ('IndexOptions()', false, false, false)) v(text, case_folding, remove_stop_words, do_stemming)")
def options_parse(spark, sf_dir):
    rows = []
    for text in ("IndexOptions(CaseFolding)", "IndexOptions(CaseFolding, DoStemming)", "IndexOptions(CaseFolding,RemoveStopWords,DoStemming)", "IndexOptions()"):
        o = IndexOptions.parse(text)
        rows.append((text, o.case_folding, o.remove_stop_words, o.do_stemming))
    return spark.createDataFrame(rows, "text string, case_folding boolean, remove_stop_words boolean, do_stemming boolean")
