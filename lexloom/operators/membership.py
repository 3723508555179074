"""Counting words of a set: six ways to say it, one answer."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.storage import scratch_path


def by_hash_set(tokens: DataFrame, words: list[str]) -> DataFrame:
    """`isin`: a chain of comparisons up to ten words, a generated hash set above."""
    return tokens.where(F.col("term").isin(words)).agg(F.count(F.lit(1)).alias("n"))


def by_comparisons(tokens: DataFrame, words: list[str]) -> DataFrame:
    """Short words only, then one comparison after the other."""
    longest = max(map(len, words))
    return tokens.where((F.length("term") <= longest) & reduce(lambda a, b: a | b, [F.col("term") == w for w in words])).agg(F.count(F.lit(1)).alias("n"))


def by_sorted_array(tokens: DataFrame, words: list[str]) -> DataFrame:
    """Binary search over the sorted words, as a balanced tree of comparisons."""

    def search(part: list[str]) -> Column:
        if len(part) <= 2:
            return reduce(lambda a, b: a | b, [F.col("term") == w for w in part], F.lit(False))
        middle = len(part) // 2
        return F.when(F.col("term") < part[middle], search(part[:middle])).otherwise(search(part[middle:]))

    return tokens.where(search(sorted(set(words), key=str.encode))).agg(F.count(F.lit(1)).alias("n"))


def by_map(tokens: DataFrame, words: list[str]) -> DataFrame:
    """Hash code first (whole numbers, for which Spark generates a switch), the words themselves where it is among theirs."""
    codes = tokens.sparkSession.createDataFrame([(w,) for w in words], "w string").select(F.hash("w").alias("c"))
    found = sorted({r["c"] for r in codes.collect()})  # as many as there are words
    return tokens.where(F.hash("term").isin(found)).where(F.col("term").isin(words)).agg(F.count(F.lit(1)).alias("n"))


def by_semi_join(tokens: DataFrame, words: list[str]) -> DataFrame:
    """Left semi join with the words as a table (a few rows, broadcast)."""
    table = tokens.sparkSession.createDataFrame([(w,) for w in words], "term string")
    return tokens.join(F.broadcast(table), "term", "left_semi").agg(F.count(F.lit(1)).alias("n"))


def by_grouping(tokens: DataFrame, words: list[str]) -> DataFrame:
    """Counts per term first (combined on the map side), membership after."""
    counts = tokens.groupBy("term").agg(F.count(F.lit(1)).alias("c"))
    return counts.where(F.col("term").isin(words)).agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"))


METHODS = {"hash_set": by_hash_set, "comparisons": by_comparisons, "sorted_array": by_sorted_array, "map": by_map, "semi_join": by_semi_join, "grouping": by_grouping}


def count_members(tokens: DataFrame, words: list[str]) -> DataFrame:
    """method, n: all six, over tokens that are made once and written to the shared folder."""
    spark, path = tokens.sparkSession, scratch_path(tokens.sparkSession, "tokens")
    tokens.select("term").write.parquet(path)
    tokens = spark.read.schema("term string").parquet(path)
    parts = [f(tokens, words).select(F.lit(name).alias("method"), F.col("n").cast("bigint").alias("n")) for name, f in METHODS.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)
