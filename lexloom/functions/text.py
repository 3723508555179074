"""Text to terms, as column expressions."""

from __future__ import annotations

import sys
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from lexloom.functions import porter

# The stop words of the index and the query side.
STOP_WORDS = [
    "a", "an", "and", "also", "all", "are", "as", "at", "be", "been", "by", "but", "for", "from",
    "have", "has", "had", "he", "in", "is", "it", "its", "more", "new", "not",
    "of", "on", "page", "part", "that", "the", "this",
    "to", "s", "was", "were", "will", "with", "1", "2", "3",
]

# The stop words of the membership benchmark, in its order.
BENCH_STOP_WORDS = [
    "a", "an", "and", "also", "all", "are", "as", "at", "be", "been",
    "by", "but", "for", "from", "have", "has", "had", "he", "in", "is",
    "it", "its", "more", "my", "new", "not", "of", "on", "or",
    "page", "part", "that", "the", "this", "to", "s", "she", "was", "were",
    "will", "with", "i", "you", "they", "up", "so", "if", "ok", "make",
]

#: Characters that separate words in documents: controls, blank, !"#$%&'()*+,-./ and : ; = ?
INDEX_SEPARATORS = r"[\x00-/:;=?]"
#: Characters that separate words in topics.
QUERY_SEPARATORS = r"[, .();:?/]"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SMALL = CAPITALS.lower()


def index_words(content: Column, max_len: int | None = None) -> Column:
    """Words of a document, in order: what stands before each separator. Text after the last separator gives no word, nor
    do words that start with '<' or end with '>'. Longer words than max_len are left out if it is given. Null: no words."""
    closed = F.regexp_extract(F.coalesce(content, F.lit("")), "(?s)^.*" + INDEX_SEPARATORS, 0)  # up to the last separator

    def keep(w: Column) -> Column:
        good = (w != "") & ~w.startswith("<") & ~w.endswith(">")
        return good & (F.length(w) <= max_len) if max_len else good

    return F.filter(F.split(closed, INDEX_SEPARATORS, -1), keep)


def fold_ascii(word: Column) -> Column:
    """A-Z to small letters; other capitals stay."""
    return F.translate(word, CAPITALS, SMALL)


def is_stop_word(word: Column, words: list[str] | None = None) -> Column:
    return word.isin(words or STOP_WORDS)


def query_words(line: Column) -> Column:
    """Words of a topic line: cut at topic separators, not blank, not starting with '<'. The last word counts."""
    return F.filter(F.split(F.coalesce(line, F.lit("")), QUERY_SEPARATORS, -1), lambda w: (F.trim(F.regexp_replace(w, r"\s", " ")) != "") & ~w.startswith("<"))


def index_terms(content: Column, case_folding: bool = False, remove_stop_words: bool = False, max_len: int | None = None) -> Column:
    """Array of a document's terms before stemming."""
    words = index_words(content, max_len)
    if case_folding:
        words = F.transform(words, fold_ascii)
    if remove_stop_words:
        words = F.filter(words, lambda w: ~is_stop_word(w))
    return words


def query_terms(line: Column, case_folding: bool = False, remove_stop_words: bool = False) -> Column:
    """Array of a topic line's terms before stemming: folding covers all of Unicode here."""
    words = query_words(line)
    if case_folding:
        words = F.transform(words, F.lower)
    if remove_stop_words:
        words = F.filter(words, lambda w: ~is_stop_word(w))
    return words


def _strings(words: list[bytes]) -> pa.Array:
    """Bytes as strings; what isn't valid UTF-8 is replaced, as Spark's expressions do."""
    data = b"".join(words)
    try:
        data.isascii() or data.decode()
    except UnicodeDecodeError:
        return pa.array([w.decode("utf-8", "replace") for w in words], pa.string())
    ends = np.zeros(len(words) + 1, np.int32)
    np.cumsum(np.fromiter(map(len, words), np.int32, len(words)), out=ends[1:])
    return pa.StringArray.from_buffers(len(words), pa.py_buffer(ends), pa.py_buffer(data))


def term_counter(case_folding: bool = False, remove_stop_words: bool = False, max_len: int | None = None) -> Callable[[bytes | None], Counter]:
    """The counts of the terms that index_terms gives. All separators and capitals are single bytes of UTF-8, so that one
    table cuts and folds a text; what a word must be is asked once for each distinct word."""
    separators = {*range(0x30), *b":;=?"}
    table = bytes(0x20 if c in separators else c + 32 if case_folding and 65 <= c <= 90 else c for c in range(256))
    stop = [w.encode() for w in STOP_WORDS] if remove_stop_words else []

    def count(text: bytes | None) -> Counter:
        if not text:
            return Counter()
        words = text.translate(table).split(b" ")
        words.pop()  # what stands behind the last separator
        found = Counter(words)
        bad = [b"", *stop]
        if b"<" in text or b">" in text:
            bad += [w for w in found if w[:1] == b"<" or w[-1:] == b">"]
        if max_len:
            bad += [w for w in found if len(w.decode("utf-8", "replace")) > max_len]
        for w in bad:
            found.pop(w, None)
        return found

    return count


#: Postings in an Arrow batch.
BATCH_POSTINGS = 1 << 16

#: Stems that a Python worker keeps.
KEPT_STEMS = 200_000


def stem_counts(counts: Counter, compat: bool) -> Counter:
    """Counts by stem. A worker keeps stems from task to task, as functions of this package don't outlive a task there."""
    kept = sys.__dict__.setdefault("_lexloom_stems", {}).setdefault(compat, {})
    found = Counter()
    for word, n in counts.items():
        if (stem := kept.get(word)) is None:
            if len(kept) >= KEPT_STEMS:
                kept.clear()
            stem = kept[word] = porter.stem(word.decode("utf-8", "replace"), compat).encode("utf-8", "replace")
        found[stem] += n
    return found


def count_postings(case_folding: bool, remove_stop_words: bool, max_len: int | None, stem: Callable[[Counter], Counter] | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow over doc_idx, content: term, doc_idx, tf, dl, one row for each term of a document. Rows of one doc_idx
    stand together and are summed; dl is the longest row's length, before stemming."""
    count = term_counter(case_folding, remove_stop_words, max_len)

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, Counter, int]]:
        held = None
        for batch in batches:
            for doc, text in zip(batch["doc_idx"].to_pylist(), batch["content"].cast(pa.binary()), strict=True):
                found = count(text.as_py())
                length = found.total()
                if held and held[0] == doc:
                    held = doc, held[1] + found, max(held[2], length)
                    continue
                if held:
                    yield held
                held = doc, found, length
        if held:
            yield held

    def batch_of(docs: list, sizes: list[int], lengths: list[int], words: list[bytes], counts: list[int]) -> pa.RecordBatch:
        at = pa.array(np.repeat(np.arange(len(sizes)), sizes))
        columns = [_strings(words), pa.array(docs, pa.int64()).take(at), pa.array(np.array(counts, np.int32)), pa.array(lengths, pa.int64()).take(at)]
        return pa.RecordBatch.from_arrays(columns, ["term", "doc_idx", "tf", "dl"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = docs, sizes, lengths, words, counts = [], [], [], [], []
        for doc, found, length in documents(batches):
            found = stem(found) if stem else found
            docs.append(doc), sizes.append(len(found)), lengths.append(length)
            words.extend(found), counts.extend(found.values())
            if len(words) >= BATCH_POSTINGS:
                yield batch_of(*rows)
                for column in rows:
                    column.clear()
        if words:
            yield batch_of(*rows)

    return run


def count_lengths(case_folding: bool, remove_stop_words: bool, max_len: int | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow over doc_idx, docno, content: doc_idx, docno, dl."""
    count = term_counter(case_folding, remove_stop_words, max_len)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = [count(text.as_py()).total() for text in batch["content"].cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch["doc_idx"], batch["docno"], pa.array(lengths, pa.int64())], ["doc_idx", "docno", "dl"])

    return run
