"""Stemming of a term column: each distinct term is stemmed once, in Arrow batches, and joined back."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lexloom.functions import porter


def stem_udf(compat: bool = True):
    @F.pandas_udf(StringType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for words in batches:
            yield words.map(lambda w: None if w is None else porter.stem(w, compat))

    return run


def stem_vocabulary(terms: DataFrame, column: str = "term", compat: bool = True) -> DataFrame:
    """Distinct terms with their stems: term, stem."""
    return terms.select(F.col(column).alias("term")).distinct().withColumn("stem", stem_udf(compat)(F.col("term")))


def stem_column(rows: DataFrame, column: str = "term", compat: bool = True) -> DataFrame:
    """rows with the column replaced by its stem. The vocabulary is far smaller than the rows; Spark chooses the join."""
    stems = stem_vocabulary(rows, column, compat).select(F.col("term").alias("__t"), "stem")
    return rows.join(stems, rows[column] == F.col("__t")).withColumn(column, F.col("stem")).drop("__t", "stem")
