"""Ranking functions: per matched posting a contribution, summed per topic and document.

All topics are scored in one job; the topic is a column. What depends on topic and term alone (idf, k1, weights) is computed
on these few rows before the postings are joined; Spark broadcasts them while they are small.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom.operators.index import InvertedIndex
from lexloom.storage import dealt_by, if_small, scratch_path


class Scorer(Protocol):
    """A ranking function. `name` is used in run files."""

    name: str

    def contributions(self, index: InvertedIndex, topics: DataFrame) -> DataFrame:
        """topics: topic, kw_pos, term, qtf. Returns topic, kw_pos, doc_idx, score: one row per matched posting."""
        ...


def materialise(table: DataFrame) -> DataFrame:
    """A small table, written to the shared folder and read back."""
    path = scratch_path(table.sparkSession, "parameters")
    table.write.parquet(path)
    return table.sparkSession.read.schema(table.schema).parquet(path)


def query_postings(index: InvertedIndex, topics: DataFrame) -> DataFrame:
    """Postings of the topics' terms only."""
    return index.postings.join(if_small(topics.select("term").distinct()), "term", "left_semi")


#: Bytes of saved postings whose documents are scored together: some 2 million postings.
SCORED_BYTES = 8 << 20


def by_document(postings: DataFrame) -> DataFrame:
    """Postings dealt out by document. Contributions, one for each posting and topic that asks for its term, are many times as
    many; they are then made and summed where the document lies, and no sum is shuffled."""
    return dealt_by(postings, "doc_idx", part_bytes=SCORED_BYTES)


def _weighted(index: InvertedIndex, topics: DataFrame, **weights) -> DataFrame:
    """topic, kw_pos, the weights (columns made of df and qtf, one row per topic and term), doc_idx, tf, dl: a row per posting.

    Where frequencies aren't saved they are counted over the query terms' postings only."""
    stats = index.terms if index.terms is not None else query_postings(index, topics).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    known = materialise(topics.join(stats, "term").select("topic", "kw_pos", "term", *[w.alias(name) for name, w in weights.items()]))
    return by_document(query_postings(index, known)).join(if_small(known), "term")


@dataclass(frozen=True)
class TfIdf:
    """ln(1 + tf) * ln(N div df): whole-number division, so terms in over half of the documents count nothing."""

    name: str = "TfIdfScorer"

    def contributions(self, index: InvertedIndex, topics: DataFrame) -> DataFrame:
        n, _ = index.corpus_numbers()
        rows = _weighted(index, topics, idf=F.log(F.expr(f"{n}L div df").cast("double")))
        return rows.select("topic", "kw_pos", "doc_idx", (F.log(F.lit(1) + F.col("tf")) * F.col("idf")).alias("score"))


@dataclass(frozen=True)
class Bm25:
    """Okapi BM25 with query term weights; the idf may be negative."""

    k1: float = 1.2
    k3: float = 100.0
    b: float = 0.75
    name: str = "BM25Scorer"

    def contributions(self, index: InvertedIndex, topics: DataFrame) -> DataFrame:
        n, avg = index.corpus_numbers()
        idf = F.log((F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        norm = F.lit(self.k1) * (F.lit(1 - self.b) + F.lit(self.b) * (F.col("dl") / F.lit(avg)))
        weight = F.lit(self.k3 + 1) * F.col("qtf") / (F.lit(self.k3) + F.col("qtf"))
        rows = _weighted(index, topics, idf=idf, weight=weight)
        return rows.select("topic", "kw_pos", "doc_idx", (F.col("idf") * (F.col("tf") * F.lit(self.k1 + 1) / (F.col("tf") + norm)) * F.col("weight")).alias("score"))


#: Terms are looked at up to this normalised frequency.
LAST = 99


def k1_grid() -> list[float]:
    """0.2, 0.3, ... as running sums in double precision, up to 2.5."""
    out, j = [], 0.2
    while j <= 2.5:
        out.append(j)
        j += 0.1
    return out


@dataclass(frozen=True)
class AdaptiveBm25:
    """BM25 whose k1 is fitted per term to the information gain of seeing the term once more."""

    b: float = 0.75
    name: str = "BM25ADPT"

    def normalised_tf(self, avg: float):
        """Single precision, as everything that is compared with it."""
        return (F.col("tf") / (F.lit(1 - self.b) + F.lit(self.b) * F.col("dl") / F.lit(avg))).cast("float")

    def term_parameters(self, index: InvertedIndex, terms: DataFrame) -> DataFrame:
        """terms: term. Per term found in the index: term, df, ig1 (float), n_ig (int), k1 (float)."""
        n, avg = index.corpus_numbers()
        postings = query_postings(index, terms)
        # How many postings have a normalised frequency that rounds to t, t = 101 and more together: at most 102 rows a term.
        bucket = F.least(F.floor(self.normalised_tf(avg).cast("double") + 0.5), F.lit(LAST + 2)).cast("int")
        histogram = postings.groupBy("term", bucket.alias("t")).agg(F.count(F.lit(1)).alias("n"))
        total = histogram.groupBy("term").agg(F.sum("n").alias("df"))
        grid = total.select("term", "df", F.explode(F.sequence(F.lit(0), F.lit(LAST + 1))).alias("t"))
        at_least = grid.alias("g").join(histogram.alias("h"), F.col("g.term") == F.col("h.term")).groupBy("g.term", "g.df", "g.t").agg(F.sum(F.when(F.col("h.t") >= F.col("g.t"), F.col("h.n")).otherwise(0)).alias("m"))
        counts = at_least.select("term", "df", "t", F.when(F.col("t") == 0, F.lit(n)).when(F.col("t") == 1, F.col("df")).otherwise(F.col("m")).alias("d"))
        by_term = Window.partitionBy("term").orderBy("t")
        gain = (-F.log2((F.col("df") + 0.5) / F.lit(n + 1)) + F.log2((F.col("next") + 0.5) / (F.col("d") + 1))).cast("float")
        gains = counts.withColumn("next", F.lead("d").over(by_term)).where(F.col("t") <= LAST).select("term", "df", "t", gain.alias("ig"))
        # The series ends at the first fall; the value there counts as 0.
        falls = gains.withColumn("before", F.lag("ig").over(by_term))
        cut = F.min(F.when(F.col("before") > F.col("ig"), F.col("t"))).over(Window.partitionBy("term"))
        series = falls.withColumn("cut", cut).where(F.col("cut").isNull() | (F.col("t") <= F.col("cut"))).withColumn("ig", F.when(F.col("t") == F.col("cut"), F.lit(0.0).cast("float")).otherwise(F.col("ig")))
        whole = Window.partitionBy("term")
        first = F.max(F.when(F.col("t") == 1, F.col("ig"))).over(whole)
        series = series.withColumn("ig1", first).withColumn("n_ig", F.count(F.lit(1)).over(whole).cast("int"))
        share = F.when(F.col("ig1") != 0, (F.col("ig").cast("double") / F.col("ig1").cast("double")).cast("float").cast("double"))
        tried = series.withColumn("share", share).withColumn("j", F.explode(F.array(*[F.lit(j) for j in k1_grid()])))
        error = tried.groupBy("term", "df", "ig1", "n_ig", "j").agg(F.sum(F.pow(F.col("share") - (F.col("j") + 1) * F.col("t") / (F.col("j") + F.col("t")), F.lit(2.0))).alias("e"))
        best = error.groupBy("term", "df", "ig1", "n_ig").agg(F.min(F.struct(F.coalesce(F.col("e"), F.lit(0.0)).alias("e"), F.col("j"))).alias("b"))
        return best.select("term", "df", "ig1", "n_ig", F.col("b.j").cast("float").alias("k1"))

    def contributions(self, index: InvertedIndex, topics: DataFrame) -> DataFrame:
        _, avg = index.corpus_numbers()
        parameters = self.term_parameters(index, topics.select("term").distinct())
        known = materialise(topics.join(parameters, "term").select("topic", "kw_pos", "term", "qtf", "ig1", "k1"))
        rows = by_document(query_postings(index, known)).join(if_small(known), "term").withColumn("c", self.normalised_tf(avg))
        one = F.lit(1.0).cast("float")
        gain = (F.col("c") * (F.col("k1") + one) / (F.col("k1") + F.col("c"))).cast("float")
        return rows.select("topic", "kw_pos", "doc_idx", (F.col("qtf").cast("float") * gain * F.col("ig1")).cast("double").alias("score"))


SCORERS: list[Scorer] = [TfIdf(), Bm25(), AdaptiveBm25()]
