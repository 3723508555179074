"""Document collections: TREC SGML files, and tables with an id and a text."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexloom.storage import hadoop_path, if_small

START, MIDDLE, END = "<DOCNO>", "</DOCNO>", "</DOC>"


def _after_tag(data: str, at: int, tag: str) -> int:
    """The place behind the next occurrence of tag, or -1. A character that breaks off a partial match is not looked at
    again, so a tag that begins there is missed."""
    while (at := data.find(tag[0], at)) >= 0:
        n = 1
        while n < len(tag) and data[at + n : at + n + 1] == tag[n]:
            n += 1
        if n == len(tag):
            return at + n
        at += n + 1
    return -1


def split_strict(data: str) -> Iterator[tuple[str, str]]:
    """(docno, content) of each document that is closed. The content lacks its last character."""
    at = 0
    while (a := _after_tag(data, at, START)) >= 0 and (b := _after_tag(data, a, MIDDLE)) >= 0 and (at := _after_tag(data, b, END)) >= 0:
        yield data[a : b - len(MIDDLE)].strip(), data[b : max(b, at - len(END) - 1)]


def split_native(text: Column) -> Column:
    """Array of struct<docno, content> by built-in expressions; the same for texts without broken tags."""
    pieces = F.split(F.coalesce(text, F.lit("")), END, -1)
    closed = F.filter(F.slice(pieces, F.lit(1), F.size(pieces) - 1), lambda p: p.contains(START) & F.regexp_like(p, F.lit(r"(?s)<DOCNO>.*?</DOCNO>")))

    def parse(p: Column) -> Column:
        content = F.regexp_extract(p, r"(?s)<DOCNO>.*?</DOCNO>(.*)$", 1)
        return F.struct(F.trim(F.regexp_replace(F.regexp_extract(p, r"(?s)<DOCNO>(.*?)</DOCNO>", 1), r"^\s+|\s+$", "")).alias("docno"), F.substring(content, F.lit(1), F.greatest(F.length(content) - 1, F.lit(0))).alias("content"))

    return F.transform(closed, parse)


def number_documents(docs: DataFrame, *files: str, place: str = "pos") -> DataFrame:
    """Adds doc_idx, dense from 0 in the order of (files, place): running sums over files, or over their blocks, none over
    documents. Places are dense in each file or block, whatever they start at."""
    names = [f"__f{i}" for i in range(len(files))]
    per_file = docs.groupBy(*[F.col(f).alias(n) for f, n in zip(files, names, strict=True)]).agg(F.count(F.lit(1)).alias("__n"), F.min(place).alias("__p"))
    before = Window.orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_file.select(*names, (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__p")).alias("__o"))
    same = [docs[f] == F.col(n) for f, n in zip(files, names, strict=True)]
    return docs.join(if_small(offsets), same).withColumn("doc_idx", F.col("__o") + F.col(place)).drop(*names, "__o")


#: A proper beginning of a tag followed by another '<': there the strict scanner may miss a tag.
BROKEN = "<(/?(D(O(C(N(O)?)?)?)?)?)?<"


def is_regular(text: Column) -> Column:
    """Texts in which split_native finds what the strict scanner finds: no broken tags, and no name left open at a </DOC>."""
    pieces = F.split(F.coalesce(text, F.lit("")), END, -1)
    open_name = F.exists(pieces, lambda p: p.contains(START) & ~F.regexp_like(p, F.lit(r"(?s)<DOCNO>.*?</DOCNO>")))
    return ~F.coalesce(F.regexp_like(text, F.lit(BROKEN)), F.lit(False)) & ~open_name


def split_files(files: DataFrame, strict: bool = True) -> DataFrame:
    """files: path, value (whole texts). path, pos, docno, content: one row per closed document. With `strict`, texts that
    aren't regular go through the scanner in Python, all others through built-in expressions with the same result."""
    native = lambda part: part.select("path", F.posexplode(split_native(F.col("value"))).alias("pos", "d")).select("path", F.col("pos").cast("bigint").alias("pos"), "d.docno", "d.content")
    if not strict:
        return native(files)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, value in zip(batch["path"], batch["value"], strict=True):  # a file at a time
                yield pd.DataFrame([(path, i, d, c) for i, (d, c) in enumerate(split_strict(value or ""))], columns=["path", "pos", "docno", "content"])

    files = files.select("path", "value")
    odd = files.where(~is_regular(F.col("value"))).mapInPandas(run, "path string, pos bigint, docno string, content string")
    return native(files.where(is_regular(F.col("value")))).unionByName(odd)


def collection_files(spark: SparkSession, folder: str, which: Column | None = None) -> DataFrame:
    """All files below folder, whatever their names, or those for which a condition on _metadata holds: path, value (the whole
    text). Empty files give an empty text or no row."""
    files = spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True).load(folder)
    files = files if which is None else files.where(which)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value"))


def collection_size(spark: SparkSession, folder: str) -> tuple[int, int]:
    """Files below folder and their bytes, from the folder's listing alone."""
    fs, at = hadoop_path(spark, folder)
    summary = fs.getContentSummary(at)
    return summary.getFileCount(), summary.getLength()


#: Larger files are read by records, by many tasks; compressed ones can't be and are read whole.
WHOLE_BYTES = 4 << 20
COMPRESSED = r"(?i)\.(gz|gzip|bz2|zst|zstd|lz4|snappy|deflate|xz)$"


def scan_strict(pieces: Iterable[str]) -> Iterator[tuple[str, str]]:
    """split_strict over a text that comes in pieces; no more is held than a document."""
    data, at, marks = "", 0, []
    for piece in pieces:
        data += piece
        while True:
            tag = (START, MIDDLE, END)[len(marks)]
            while (at := data.find(tag[0], at)) >= 0:
                n = 1
                while n < len(tag) and data[at + n : at + n + 1] == tag[n]:
                    n += 1
                if n == len(tag) or at + n >= len(data):  # all of the tag, or cut off by the piece's end
                    break
                at += n + 1
            if at < 0 or n < len(tag):
                at = len(data) if at < 0 else at
                break
            at += n
            marks.append(at)
            if len(marks) == 3:
                a, b, c = marks
                yield data[a : b - len(MIDDLE)].strip(), data[b : max(b, c - len(END) - 1)]
                data, at, marks = data[at:], 0, []
        if not marks:
            data, at = data[at:], 0


def _scan_records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Records of files, a file's together and in order, last ones marked: its documents by the strict scanner."""
    rows = (row for batch in batches for row in zip(batch["path"], batch["value"], strict=True))
    for path, own in groupby(rows, key=lambda row: row[0]):
        for i, (docno, content) in enumerate(scan_strict(value for _, value in own)):
            yield pd.DataFrame([(path, 0, i, docno, content)], columns=["path", "block", "pos", "docno", "content"])


def split_records(spark: SparkSession, folder: str, large: Column, strict: bool = True) -> DataFrame:
    """path, block, pos, docno, content of files that are read by records, which end at </DOC>: what split_files finds in their
    whole texts. `pos` grows in a block. A file's facts (is its last record closed? are all of its records regular?) are
    gathered first, by block. Spark deals one listing of files out alike each time, so row numbers are the same in all passes."""
    rows = spark.read.format("text").option("lineSep", END).option("recursiveFileLookup", True).load(folder)
    rows = rows.where(large).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_size").alias("size"), "value", F.monotonically_increasing_id().alias("id"))
    closed = F.concat("value", F.lit(END))
    odd = ~is_regular(closed) if strict else F.lit(False)
    blocks = rows.groupBy("path", "block").agg(F.max("size").alias("size"), F.sum(F.octet_length(closed)).alias("n"), F.max(odd).alias("odd"), F.max("id").alias("id"))
    # With a closing tag for each record, a file that ends in an open one would be longer than it is.
    facts = blocks.groupBy(F.col("path").alias("__p")).agg((F.sum("n") > F.max("size")).alias("open"), F.max("odd").alias("odd"), F.max(F.struct("block", "id"))["id"].alias("last"))
    rows = rows.join(if_small(facts), F.col("path") == F.col("__p")).withColumn("cut", F.col("open") & (F.col("id") == F.col("last")))
    found = rows.where(~F.col("odd") & ~F.col("cut")).select("path", "block", F.explode(split_native(closed)).alias("d"))
    native = found.select("path", "block", F.monotonically_increasing_id().alias("pos"), "d.docno", "d.content")
    if not strict:
        return native
    pieces = rows.where("odd").select("path", "block", "id", F.when(F.col("cut"), F.col("value")).otherwise(closed).alias("value"))
    pieces = pieces.repartition("path").sortWithinPartitions("path", "block", "id").select("path", "value")
    return native.unionByName(pieces.mapInPandas(_scan_records, "path string, block bigint, pos bigint, docno string, content string"))


def trec_documents(spark: SparkSession, folder: str, strict: bool = True) -> DataFrame:
    """The documents of all files below folder: doc_idx, docno, content. Small and compressed files are read whole, others by
    records."""
    large = (F.col("_metadata.file_size") > WHOLE_BYTES) & ~F.col("_metadata.file_path").rlike(COMPRESSED)
    small = split_files(collection_files(spark, folder, ~large), strict).withColumn("block", F.lit(0).cast("bigint"))
    docs = small.unionByName(split_records(spark, folder, large, strict))
    return number_documents(docs, "path", "block").select("doc_idx", "docno", "content")


def trec_documents_split(spark: SparkSession, folder: str) -> DataFrame:
    """For files too large to read whole: records end at </DOC>, so one file is read by many tasks. doc_idx is unique and
    follows the order of files, but isn't dense; a last document that isn't closed counts as closed."""
    records = spark.read.format("text").option("lineSep", END).option("recursiveFileLookup", True).load(folder)
    docs = records.select(F.explode(split_native(F.concat("value", F.lit(END)))).alias("d"))
    return docs.select(F.monotonically_increasing_id().alias("doc_idx"), "d.docno", "d.content")


def table_documents(table: DataFrame, doc_id: str, text: str) -> DataFrame:
    """A table's rows as documents; its numeric id serves as doc_idx, its text form as docno."""
    return table.select(F.col(doc_id).cast("bigint").alias("doc_idx"), F.col(doc_id).cast("string").alias("docno"), F.col(text).alias("content"))
