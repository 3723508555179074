"""`python -m lexloom index <folder> <index> IndexOptions(...)` and `... search <run> <topics> <index> QueryOptions(...)`."""

from __future__ import annotations

import sys
import time

from pyspark.sql import SparkSession

from lexloom.operators.index import InvertedIndex, build_index
from lexloom.operators.rank import search_all
from lexloom.options import IndexOptions, QueryOptions
from lexloom.sources.topics import parse_topics
from lexloom.sources.trec import collection_size, trec_documents

USAGE = """python -m lexloom index <folder> <index> IndexOptions(CaseFolding,RemoveStopWords,DoStemming)
python -m lexloom search <run name> <topic file> <index> QueryOptions(UseHeadline,UseDescription,UseNarrative) [<output folder>]"""


def index_command(spark: SparkSession, folder: str, path: str, options: str) -> None:
    began, chosen = time.time(), IndexOptions.parse(options)
    print(chosen)
    files, size = collection_size(spark, folder)
    print(f"{files} files, {size / 1e6:.1f} MB")
    build_index(trec_documents(spark, folder), chosen).save(path)
    took = max(time.time() - began, 1e-9)
    stats = InvertedIndex.load(spark, path).describe()
    print(f"{stats.n_docs} documents, {stats.n_tokens} tokens, {stats.n_terms} terms, {stats.n_postings} postings in {took:.1f} s, {size / 1e6 / took:.2f} MB/s")


def search_command(spark: SparkSession, run: str, topics: str, path: str, options: str, out: str = ".") -> None:
    index, chosen = InvertedIndex.load(spark, path), QueryOptions.parse(options)
    print(index.options, chosen, sep="")
    for written in search_all(index, parse_topics(spark, topics, chosen, index.options), out, run):
        print(written)


def main(args: list[str]) -> int:
    commands = {("index", 4): index_command, ("search", 5): search_command, ("search", 6): search_command}
    command = commands.get((args[0], len(args))) if args else None
    if command is None:
        print(USAGE)
        return 1
    command(SparkSession.builder.appName("lexloom").getOrCreate(), *args[1:])
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
