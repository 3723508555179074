"""A training corpus from documents: quality filter, near-dedup, substring dedup, source mixing, packing.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's docs. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm import mixing, packing, quality, simhash, substring
from lexloom.llm.common import MADE, drop_scratch, materialise, read_table

#: No stage but the fourth can be said in SQL, so the pipeline is tested against brute force.
ORACLE_SQL = None


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled classifier doesn't reject."""
    model = quality.fit(docs, read_table(spark, sf_dir, "labels"))
    return quality.score(docs, model, column="__ll_quality").where(F.col("__ll_quality") >= quality.THRESHOLD).drop("__ll_quality")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id."""
    return simhash.keep_one(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines and sentences that an earlier document has; n_chars follows the text."""
    cut = substring.dedup_texts(docs, names=("__ll_n", "__ll_chars", "__ll_spans")).select(*docs.columns)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut


def mix_by_source(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that each source has its target share, in shuffled order."""
    return mixing.mix_sources(docs, names=("__ll_n", "__ll_copy", "__ll_order")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the packed sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("SimHash near-dedup", drop_near_copies),
    ("substring dedup", drop_repeated_passages),
    ("source mixing", mix_by_source),
    ("best-fit packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, over all of documents."""
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        made = len(MADE)
        docs = materialise(stage(spark, docs, sf_dir), "stage")
        drop_scratch(spark, made, keep=MADE[-1])  # what only this stage has read
    return STAGES[-1][1](spark, docs, sf_dir)
