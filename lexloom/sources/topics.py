"""Topics: TREC topic files, and tables with an id and a text."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexloom.functions.stemming import stem_column
from lexloom.functions.text import query_terms
from lexloom.options import IndexOptions, QueryOptions

ID_COLUMN, TITLE_COLUMN = 14, 8


class TopicError(ValueError):
    """A line that is too short for what it should hold."""


def topic_lines(lines: Iterable[str], options: QueryOptions) -> list[tuple[int, int, str]]:
    """(topic, line number, text) of the lines that give query words; a topic without any has one empty line.

    The section stays open across topics until another one opens: text after the next <num> still belongs to it, and so
    does a <title> line where headlines aren't used.
    """
    found, held, topic, section = [], [], 0, None
    wanted = {"<desc>": options.use_description, "<narr>": options.use_narrative}
    for number, line in enumerate(lines):
        if line.startswith("<num>"):
            try:
                topic = int(line[ID_COLUMN:])
            except ValueError as e:
                raise TopicError(f"line {number + 1}: no topic number from column {ID_COLUMN}") from e
        elif line.startswith("<title>") and options.use_headline:
            if len(line) < TITLE_COLUMN:
                raise TopicError(f"line {number + 1}: no title")
            held.append((number, line[TITLE_COLUMN:]))
        elif (mark := line[:6]) in wanted:
            section = mark
        elif line.startswith("</top>"):
            found += [(topic, n, text) for n, text in held] or [(topic, number, "")]
            held, topic = [], 0
        elif section and wanted[section]:
            held.append((number, line))
    return found


def keywords(lines: DataFrame, options: IndexOptions, compat_stemmer: bool = True) -> DataFrame:
    """lines: topic, line, text. topic, kw_pos (from 0, by first occurrence), term, qtf."""
    words = lines.select("topic", "line", F.posexplode(query_terms(F.col("text"), options.case_folding, options.remove_stop_words)).alias("pos", "term"))
    if options.do_stemming:
        words = stem_column(words, "term", compat_stemmer).where("term <> ''")
    counted = words.groupBy("topic", "term").agg(F.min(F.struct("line", "pos")).alias("first"), F.count(F.lit(1)).cast("int").alias("qtf"))
    order = Window.partitionBy("topic").orderBy("first")
    return counted.select("topic", (F.row_number().over(order) - 1).cast("int").alias("kw_pos"), "term", "qtf")


def parse_topics(spark: SparkSession, path: str, query: QueryOptions, index: IndexOptions) -> DataFrame:
    """A topic file's keywords. A file holds some hundred topics; its lines are cut into sections on the driver."""
    text = "\n".join(r["value"] for r in spark.read.option("wholetext", True).text(path).collect())
    rows = topic_lines(text.replace("\r\n", "\n").split("\n"), query)
    return keywords(spark.createDataFrame(rows, "topic int, line int, text string"), index)


def table_topics(table: DataFrame, topic_id: str, text: str, index: IndexOptions) -> DataFrame:
    """Each row is a topic whose title is the text."""
    return keywords(table.select(F.col(topic_id).cast("int").alias("topic"), F.lit(0).alias("line"), F.col(text).alias("text")), index)
