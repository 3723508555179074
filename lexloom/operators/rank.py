"""Sums of contributions, the best documents per topic, and run files."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.operators.index import POSTINGS, InvertedIndex
from lexloom.operators.scoring import SCORERS, Scorer, query_postings
from lexloom.storage import dealt_by, hadoop_path, lies_by, scratch_path

#: As many documents per topic as a run file holds. Spark cuts ranks before the shuffle up to this number.
DEPTH = 1000


#: Contributions that are summed at once; a document's are never parted.
SUMMED_ROWS = 1 << 20
_NONE = {"topic": -(2**31), "kw_pos": -(2**31), "doc_idx": -(2**63)}


def _sums(topic: np.ndarray, kw_pos: np.ndarray, doc: np.ndarray, score: np.ndarray, empty: np.ndarray) -> pa.RecordBatch:
    """doc is sorted. Single-precision additions, one after the other, in keyword order for each topic and document."""
    new = np.concatenate([[0], doc[1:] != doc[:-1]]).cumsum()
    names, code = np.unique(topic, return_inverse=True)
    pairs, at = np.unique(new * len(names) + code, return_inverse=True)
    total, first, void = np.zeros(len(pairs), np.float32), np.full(len(pairs), 2**31 - 1, np.int32), np.zeros(len(pairs), bool)
    order = np.argsort(kw_pos, kind="stable")
    np.add.at(total, at[order], score[order])
    np.minimum.at(first, at, kw_pos)
    void[at[empty]] = True
    topics, docs = names[pairs % len(names)], doc[np.flatnonzero(np.diff(new, prepend=-1))][pairs // len(names)]
    columns = [pa.array(topics, mask=topics == _NONE["topic"]), pa.array(docs, mask=docs == _NONE["doc_idx"]), pa.array(total, mask=void), pa.array(first)]
    return pa.RecordBatch.from_arrays(columns, ["topic", "doc_idx", "score", "first_kw"])


def sum_in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over topic, kw_pos, doc_idx, score in document order: topic, doc_idx, score, first_kw."""
    held: list[tuple[np.ndarray, ...]] = []
    n = 0
    for batch in batches:
        plain = [batch[c].fill_null(v).to_numpy(zero_copy_only=False) for c, v in _NONE.items()]
        held.append((*plain, batch["score"].fill_null(0.0).to_numpy(zero_copy_only=False), batch["score"].is_null().to_numpy(zero_copy_only=False)))
        n += batch.num_rows
        if n >= SUMMED_ROWS:
            rows = [np.concatenate(c) for c in zip(*held, strict=True)]
            cut = int(np.searchsorted(rows[2], rows[2][-1]))
            if cut:
                yield _sums(*[c[:cut] for c in rows])
            held = [tuple(c[cut:] for c in rows)]
            n = 0 if cut else n
    if held and len(held[0][0]) + sum(len(h[0]) for h in held[1:]):
        yield _sums(*[np.concatenate(c) for c in zip(*held, strict=True)])


def accumulate(contributions: DataFrame, precision: str = "double") -> DataFrame:
    """topic, doc_idx, score, first_kw. `float32` adds single-precision contributions in keyword order."""
    grouped = contributions.groupBy("topic", "doc_idx")
    if precision == "double":
        return grouped.agg(F.sum("score").alias("score"), F.min("kw_pos").alias("first_kw"))
    if precision != "float32":
        raise ValueError(precision)
    rows = contributions.select(F.col("topic").cast("int").alias("topic"), F.col("kw_pos").cast("int").alias("kw_pos"), F.col("doc_idx").cast("bigint").alias("doc_idx"), F.col("score").cast("float").alias("score"))
    rows = rows if lies_by(rows, "doc_idx") else dealt_by(rows, "doc_idx")
    return rows.sortWithinPartitions("doc_idx").mapInArrow(sum_in_order, "topic int, doc_idx bigint, score float, first_kw int")


def top_documents(scores: DataFrame, depth: int = DEPTH, digits: int | None = None) -> DataFrame:
    """topic, rank, doc_idx, score. Ties go to the document that an earlier keyword found, then to the smaller number."""
    shown: Column = F.round("score", digits) if digits is not None else F.col("score")
    order = Window.partitionBy("topic").orderBy(F.desc("score"), F.asc("first_kw"), F.asc("doc_idx"))
    ranked = scores.withColumn("score", shown).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= depth)
    return ranked.select("topic", F.col("rank").cast("int").alias("rank"), "doc_idx", "score")


def search(index: InvertedIndex, topics: DataFrame, scorer: Scorer, depth: int = DEPTH, digits: int | None = None, precision: str = "double") -> DataFrame:
    """topic, rank, docno, score: names are looked up for the ranked documents only."""
    best = top_documents(accumulate(scorer.contributions(index, topics), precision), depth, digits)
    return best.join(index.docs.select("doc_idx", "docno"), "doc_idx").select("topic", "rank", "docno", "score")


def plain_score(score: Column, digits: int = 7) -> Column:
    """A single-precision score in at most so many significant digits, without trailing zeros: 0.981644, 12, 1.5E-05."""
    text = F.format_string(f"%.{digits}g", score.cast("float").cast("double"))
    return F.upper(F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+(?=e|$)", "$1"), r"\.(?=e|$)", ""))


def run_lines(run: DataFrame, run_name: str, score_format: str | None = None) -> DataFrame:
    """topic, rank, line: `topic Q0 docno rank score run`."""
    score = F.format_string(score_format, F.col("score").cast("double")) if score_format else plain_score(F.col("score"))
    return run.select("topic", "rank", F.concat_ws(" ", F.col("topic").cast("string"), F.lit("Q0"), F.col("docno"), F.col("rank").cast("string"), score, F.lit(run_name)).alias("line"))


def run_file_name(run_name: str, scorer: Scorer) -> str:
    return f"results-{run_name}-{scorer.name}.txt"


def write_run(run: DataFrame, path: str, run_name: str) -> None:
    """One text file in topic and rank order; replaces what is there. It has at most `depth` lines a topic."""
    spark = run.sparkSession
    parts = f"{path}.parts"
    run_lines(run, run_name).orderBy("topic", "rank").select("line").coalesce(1).write.mode("overwrite").text(parts)
    fs, folder = hadoop_path(spark, parts)
    final = hadoop_path(spark, path)[1]
    fs.delete(final, True)
    for status in fs.listStatus(folder):
        if status.getPath().getName().startswith("part-"):
            fs.rename(status.getPath(), final)
    fs.delete(folder, True)


def search_all(index: InvertedIndex, topics: DataFrame, folder: str, run_name: str, scorers: Iterable[Scorer] = SCORERS) -> list[str]:
    """A run for each scorer over the same topics; returns the paths. The topics' postings are picked once and written to the
    shared folder, and all scorers read those."""
    spark = topics.sparkSession
    scratch = scratch_path(spark, "search")
    topics.write.parquet(f"{scratch}/topics")
    topics = spark.read.schema(topics.schema).parquet(f"{scratch}/topics")
    query_postings(index, topics).select("term", "doc_idx", "tf", "dl").write.parquet(f"{scratch}/postings")
    picked = spark.read.schema(POSTINGS).parquet(f"{scratch}/postings")
    index.corpus_numbers()
    terms = index.terms if index.terms is not None else picked.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    index = replace(index, postings=picked, terms=terms)
    paths = []
    for scorer in scorers:
        paths.append(f"{folder}/{run_file_name(run_name, scorer)}")
        write_run(search(index, topics, scorer), paths[-1], run_name)
    fs, at = hadoop_path(spark, scratch)
    fs.delete(at, True)
    return paths
