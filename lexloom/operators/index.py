"""The inverted index as DataFrames, its statistics, lookups, merge and storage.

A posting carries its document's length, so that scoring needs no join with the documents. A saved index also holds the
document frequencies and the corpus numbers; a search in it reads postings once and no text.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions.text import count_lengths, count_postings, stem_counts
from lexloom.options import IndexOptions
from lexloom.storage import dealt_by

DOCS = "doc_idx bigint, docno string, dl bigint"
POSTINGS = "term string, doc_idx bigint, tf int, dl bigint"
TERMS = "term string, df bigint"
NUMBERS = "n_docs bigint, n_tokens bigint"


@dataclass
class IndexStats:
    """What a build has seen."""

    n_docs: int
    n_tokens: int
    n_terms: int
    n_postings: int


@dataclass
class InvertedIndex:
    """docs(doc_idx, docno, dl), postings(term, doc_idx, tf, dl) and the options the terms were made with; terms(term, df)
    and numbers (documents, tokens) where they are known."""

    docs: DataFrame
    postings: DataFrame
    options: IndexOptions
    terms: DataFrame | None = None
    numbers: tuple[int, int] | None = None

    # -- statistics --
    def term_stats(self) -> DataFrame:
        """term, df."""
        return self.terms if self.terms is not None else self.postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))

    def corpus_stats(self) -> DataFrame:
        """n_docs and avg_dl over all documents, empty ones too; avg_dl is null without documents."""
        return self.docs.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avg_dl"))

    def corpus_numbers(self) -> tuple[int, float]:
        """Documents and their average length (0 without documents); asked for once."""
        if self.numbers is None:
            self.numbers = tuple(self.docs.agg(F.count(F.lit(1)), F.coalesce(F.sum("dl"), F.lit(0))).collect()[0])
        n, tokens = self.numbers
        return n, tokens / n if n else 0.0

    def term_length_histogram(self, rows: int = 100) -> DataFrame:
        """Number of terms by length, longest first."""
        return self.term_stats().groupBy(F.length("term").alias("term_length")).agg(F.count(F.lit(1)).alias("n_terms")).orderBy(F.desc("term_length")).limit(rows)

    def posting_length_histogram(self, rows: int = 100) -> DataFrame:
        """Number of terms by document frequency, smallest first."""
        return self.term_stats().groupBy("df").agg(F.count(F.lit(1)).alias("n_terms")).orderBy("df").limit(rows)

    def stop_word_candidates(self, threshold: int = 100_000, max_length: int = 4) -> DataFrame:
        """Short terms in more than threshold documents, most frequent first."""
        return self.term_stats().where((F.col("df") > threshold) & (F.length("term") <= max_length)).orderBy(F.desc("df"), "term")

    def describe(self) -> IndexStats:
        self.corpus_numbers()
        t = self.term_stats().agg(F.count(F.lit(1)), F.coalesce(F.sum("df"), F.lit(0))).collect()[0]
        return IndexStats(*self.numbers, t[0], t[1])

    # -- lookups --
    def posting_lists(self, terms: DataFrame) -> DataFrame:
        """terms (kw_pos, term) joined to their postings, in keyword order; unknown terms give nothing."""
        return terms.join(self.postings, "term").select("kw_pos", "term", "doc_idx", "tf")

    def posting_arrays(self, block: int = 1 << 20) -> DataFrame:
        """term, block, postings: a term's postings as arrays in document order, one for each `block` document numbers, so
        that a row is bounded however frequent the term is."""
        at = F.floor(F.col("doc_idx") / F.lit(block)).cast("bigint").alias("block")
        dealt = dealt_by(self.postings.select("term", at, "doc_idx", "tf"), "term", "block")  # before lists are made, not lists
        return dealt.groupBy("term", "block").agg(F.sort_array(F.collect_list(F.struct("doc_idx", "tf"))).alias("postings"))

    def find_document(self, docno: str) -> DataFrame:
        """The first doc_idx of that name, -1 if there is none."""
        return self.docs.where(F.col("docno") == docno).agg(F.coalesce(F.min("doc_idx"), F.lit(-1)).cast("bigint").alias("doc_idx"))

    # -- merge and storage --
    def merge(self, other: InvertedIndex) -> InvertedIndex:
        """Both collections in one index; the other's documents are numbered after this one's."""
        if self.options != other.options:
            raise ValueError("indexes made with different options can't be merged")
        offset = self.docs.agg(F.coalesce(F.max("doc_idx") + 1, F.lit(0))).collect()[0][0]
        move = lambda d: d.withColumn("doc_idx", F.col("doc_idx") + F.lit(offset).cast("bigint"))
        return InvertedIndex(self.docs.unionByName(move(other.docs)), self.postings.unionByName(move(other.postings)), self.options)

    def save(self, path: str) -> None:
        """A folder with docs, postings, terms, numbers and meta; replaces what is there. Postings are written as they lie, a
        document's together, so that they are made once and neither shuffled nor sorted."""
        spark = self.docs.sparkSession
        self.docs.write.mode("overwrite").parquet(f"{path}/docs")
        self.postings.select("term", "doc_idx", "tf", "dl").write.mode("overwrite").parquet(f"{path}/postings")
        spark.read.schema(POSTINGS).parquet(f"{path}/postings").groupBy("term").agg(F.count(F.lit(1)).alias("df")).write.mode("overwrite").parquet(f"{path}/terms")
        numbers = spark.read.schema(DOCS).parquet(f"{path}/docs").agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.sum("dl"), F.lit(0)).alias("n_tokens"))
        numbers.write.mode("overwrite").parquet(f"{path}/numbers")
        flags = asdict(self.options)
        meta = spark.range(1).select(*[F.lit(v).alias(k) for k, v in flags.items()])
        meta.write.mode("overwrite").parquet(f"{path}/meta")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> InvertedIndex:
        read = lambda name, schema: spark.read.schema(schema).parquet(f"{path}/{name}")
        flags = spark.read.parquet(f"{path}/meta").collect()[0].asDict()
        return cls(read("docs", DOCS), read("postings", POSTINGS), IndexOptions(**flags), read("terms", TERMS), tuple(read("numbers", NUMBERS).collect()[0]))


def build_index(docs: DataFrame, options: IndexOptions, max_len: int | None = None, compat_stemmer: bool = True) -> InvertedIndex:
    """docs: doc_idx, docno, content. Documents are dealt out by their number, as texts, which are far smaller than their
    postings; rows of one number then lie together and are summed where they lie. Terms are counted in Python, a table for
    each document, so that no posting is shuffled."""
    how = (options.case_folding, options.remove_stop_words, max_len)
    stem = partial(stem_counts, compat=compat_stemmer) if options.do_stemming else None
    docs = docs.select(F.col("doc_idx").cast("bigint").alias("doc_idx"), "docno", "content")
    lengths = docs.mapInArrow(count_lengths(*how), DOCS)
    texts = dealt_by(docs.select("doc_idx", "content"), "doc_idx").sortWithinPartitions("doc_idx")
    return InvertedIndex(lengths, texts.mapInArrow(count_postings(*how, stem), POSTINGS), options)
