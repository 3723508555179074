"""Substring dedup by hashing lines and sentences.

Units of a text are its lines (of at least `min_line` words) and, inside lines of several sentences, the sentences (of at
least `min_sentence`), so that a passage pasted into the middle of a paragraph is found too. Runs of 40 bytes and more
without a blank, as in scripts that write none, count as a word for each six bytes. A unit is
normalised (ASCII capitals to small letters, ASCII marks and white space to one blank) and hashed to 128 bits. Digests
are grouped over the whole table; the occurrence that ranks first, by (doc_id, offset), stays, all others are cut out.
Offsets always refer to the original text, in characters.

Skew: the first occurrence of a digest is a minimum, combined on the map side, so the most common line costs one row per
task; only digests that occur more than once are joined back, by a shuffle join that AQE can split. Units are written
once to the shared folder.

Memory: texts are decoded from Parquet 256 rows at a time, which the session keeps (`common.small_reads`), and go to Python
1 MB at a time; with larger arrays an executor's heap grows well beyond what is alive in it (figures in the README).

Defined results: null texts count as empty and come back as empty texts without spans; rows that repeat both id and text
are one occurrence and get equal results; a null id ranks before all others; an empty table gives an empty result; other
columns pass through `dedup_texts`, except those named like an output column, which are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import batches_of, lean, materialise, small_reads, text_of

MIN_LINE_WORDS, MIN_SENTENCE_WORDS = 10, 10
#: Runs of so many bytes without a blank (scripts that write none) count as a word for each RUN_WORD bytes.
LONG_RUN, RUN_WORD = 40, 6
#: Bytes of an Arrow batch of texts whose units are looked for.
UNIT_BATCH_BYTES = 1 << 20
#: Marks that end a sentence: . ! ? and their wide forms (as UTF-8).
MARKS, WIDE_MARKS = ".!?", "\u3002\uff01\uff1f"
_PLAIN = rb"[^.!?\n\xe3\xef]*"
_INSIDE = _PLAIN + rb"(?:(?:\xe3(?!\x80\x82)|\xef(?!\xbc[\x81\x9f]))" + _PLAIN + rb")*"
#: A sentence: up to its marks and the blanks after them, or what is left of the line.
SENTENCE = re.compile(_INSIDE + rb"(?:[.!?]|\xe3\x80\x82|\xef\xbc[\x81\x9f])+[ \t\r\x0b\x0c]*|(?=[^\n])" + _INSIDE)


def _table() -> bytes:
    """ASCII letters to small ones, digits and bytes beyond ASCII as they are, all else to a blank."""
    return bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256))


FOLD = _table()


def size_of(words: list[bytes]) -> int:
    """How many words these are, long runs counting by their length."""
    if not words or max(map(len, words)) < LONG_RUN:
        return len(words)
    return sum(len(w) // RUN_WORD if len(w) >= LONG_RUN else 1 for w in words)


def units(data: bytes, min_line: int = MIN_LINE_WORDS, min_sentence: int = MIN_SENTENCE_WORDS) -> Iterator[tuple[int, int, bool, bytes]]:
    """(start, end, whole line?, normal form) of each unit; byte offsets; a line includes its line break."""
    at = 0
    while at < len(data):
        end = data.find(b"\n", at) + 1 or len(data)
        words = data[at:end].translate(FOLD).split()
        size = size_of(words)
        if size >= min_line:
            yield at, end, True, b" ".join(words)
        if size >= min_sentence:
            parts = [m.span() for m in SENTENCE.finditer(data, at, end)]
            if len(parts) > 1:
                for a, b in parts:
                    inner = data[a:b].translate(FOLD).split()
                    if size_of(inner) >= min_sentence:
                        yield a, b, False, b" ".join(inner)
        at = end


def unit_digests(docs: DataFrame, min_line: int = MIN_LINE_WORDS, min_sentence: int = MIN_SENTENCE_WORDS) -> DataFrame:
    """docs: __ll_id, __ll_key, __ll_text (binary). Per unit: __ll_id, __ll_key, a (start), b (end), line, h1, h2."""
    kind = docs.schema["__ll_id"].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from xxhash import xxh3_128_digest

        names = ["__ll_id", "__ll_key", "a", "b", "line", "h1", "h2"]
        for batch in batches:
            rows, spans, digests = [], [], []
            for i, x in enumerate(batch.column(2)):
                for a, b, line, normal in units(x.as_py(), min_line, min_sentence):
                    rows.append(i)
                    spans.append((a, b, line))
                    digests.append(xxh3_128_digest(normal))
            if rows:
                at = pa.array(rows, pa.int64())
                h = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
                s = np.array(spans, dtype=np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(s[:, 0]), pa.array(s[:, 1]), pa.array(s[:, 2].astype(bool)), pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy())], names=names)

    return docs.select("__ll_id", "__ll_key", "__ll_text").mapInArrow(lean(run), f"__ll_id {kind}, __ll_key bigint, a bigint, b bigint, line boolean, h1 bigint, h2 bigint")


def repeated_spans(docs: DataFrame, min_line: int = MIN_LINE_WORDS, min_sentence: int = MIN_SENTENCE_WORDS) -> DataFrame:
    """Per (__ll_id, __ll_key) with something to cut: spans array<struct<a, b, line>>, in bytes."""
    with batches_of(docs.sparkSession, UNIT_BATCH_BYTES):
        found = materialise(unit_digests(docs, min_line, min_sentence), "units")
    rank = F.struct("__ll_id", "__ll_key", "a")
    first = found.groupBy("h1", "h2").agg(F.min(rank).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("h1", "h2", "first")
    later = found.join(first, ["h1", "h2"]).where(~F.col("first").eqNullSafe(rank))
    return later.groupBy("__ll_id", "__ll_key").agg(F.collect_set(F.struct("a", "b", "line")).alias("spans"))


NAMES = ("n_removed", "removed_chars", "removed_spans")


def dedup_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_line: int = MIN_LINE_WORDS, min_sentence: int = MIN_SENTENCE_WORDS, names: tuple[str, str, str] = NAMES) -> DataFrame:
    """docs' columns with the text cut, plus, under the given names: n_removed (int, spans), removed_chars (long) and removed_spans (array<struct<start, end>>, original character offsets)."""
    small_reads(docs.sparkSession)
    kept = docs.drop(*[c for c in names if c not in (doc_id, text)])
    rows = kept.withColumn(text, text_of(text))
    keyed = rows.withColumn("__ll_key", F.xxhash64(F.col(text)))
    spans = repeated_spans(keyed.select(F.col(doc_id).alias("__ll_id"), "__ll_key", F.col(text).cast("binary").alias("__ll_text")), min_line, min_sentence)
    spans = spans.select(F.col("__ll_id").alias("__ll_i"), F.col("__ll_key").alias("__ll_k"), "spans")
    joined = keyed.join(spans, keyed[doc_id].eqNullSafe(F.col("__ll_i")) & (F.col("__ll_key") == F.col("__ll_k")), "left").select(*[F.col(c) for c in rows.columns], F.col("spans").alias("__ll_spans"))
    return _cut(joined, text, names)


def cut_spans(data: bytes, found: list[tuple[int, int, bool]]) -> tuple[bytes, list[tuple[int, int]]]:
    """The text without the spans, and the spans that were cut (in characters): sentences inside a cut line count with it."""
    lines = {(a, b) for a, b, line in found if line}
    cut, end = [], -1
    for a, b in sorted([*lines, *[(a, b) for a, b, line in found if not line]], key=lambda s: (s[0], -s[1])):
        if a >= end:
            cut.append((a, b))
            end = b
    out, chars, at, place = [], [], 0, 0
    for a, b in cut:
        out.append(data[at:a])
        place += len(data[at:a].decode())
        n = len(data[a:b].decode())
        chars.append((place, place + n))
        place += n
        at = b
    out.append(data[at:])
    return b"".join(out), chars


def _cut(joined: DataFrame, text: str, names: tuple[str, str, str]) -> DataFrame:
    """Texts with spans go to Python and come back cut; all others stay where they are."""

    @F.arrow_udf("text string, spans array<struct<start: bigint, end: bigint>>")
    def cut(texts, found):
        import pyarrow as pa

        rows = []
        for x, s in zip(texts, found, strict=True):
            if not x.is_valid:
                rows.append(None)
                continue
            data, chars = cut_spans(x.as_py().encode(), [(f["a"], f["b"], f["line"]) for f in s.as_py()])
            rows.append({"text": data.decode(), "spans": [{"start": a, "end": b} for a, b in chars]})
        span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
        return pa.array(rows, pa.struct([("text", pa.string()), ("spans", pa.list_(span))]))

    done = joined.withColumn("__ll_cut", cut(F.when(F.col("__ll_spans").isNotNull(), F.col(text)), "__ll_spans"))
    spans = F.coalesce(F.col("__ll_cut.spans"), F.array().cast("array<struct<start: bigint, end: bigint>>"))
    size = F.aggregate(spans, F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    kept = [F.coalesce("__ll_cut.text", c).alias(c) if c == text else F.col(c) for c in joined.columns if c != "__ll_spans"]
    return done.select(*kept, F.size(spans).alias(names[0]), size.alias(names[1]), spans.alias(names[2]))


def query(docs: DataFrame) -> DataFrame:
    """doc_id, text (cut), n_removed, removed_chars, removed_spans ('start-end;...')."""
    done = dedup_texts(docs.select("doc_id", "text"))
    joined = F.array_join(F.transform("removed_spans", lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ";")
    return done.select("doc_id", "text", "n_removed", "removed_chars", joined.alias("removed_spans"))


_FOLD_SQL = r"""trim(regexp_replace(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-/:-@\[-`{{-\x7f]+', ' ', 'g'))"""
_WORDS_SQL = "CASE WHEN {0} = '' THEN 0 ELSE list_sum(list_transform(string_split({0}, ' '), lambda w: CASE WHEN strlen(w) >= %d THEN strlen(w) // %d ELSE 1 END)) END" % (LONG_RUN, RUN_WORD)
_ENDS = MARKS + WIDE_MARKS

ORACLE_SQL = rf"""
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS text FROM documents
), cut AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS body, generate_subscripts(string_split(text, chr(10)), 1) AS l, len(string_split(text, chr(10))) AS k FROM docs
), lines AS (
  SELECT doc_id, l, body || CASE WHEN l < k THEN chr(10) ELSE '' END AS line, body FROM cut
), placed AS (
  SELECT doc_id, l, line, body, coalesce(sum(length(line)) OVER (PARTITION BY doc_id ORDER BY l ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS a,
         {_FOLD_SQL.format("line")} AS normal FROM lines WHERE line <> ''
), parts AS (
  SELECT doc_id, l, a AS la, s, i, n FROM (
    SELECT doc_id, l, a, unnest(p) AS s, generate_subscripts(p, 1) AS i, len(p) AS n FROM (
      SELECT doc_id, l, a, regexp_extract_all(body, '[^{_ENDS}\n]*[{_ENDS}]+[ \t\r\x0b\x0c]*|[^{_ENDS}\n]+') AS p FROM placed))
), sentences AS (
  SELECT doc_id, l, i, n, s, (la + coalesce(sum(length(s)) OVER (PARTITION BY doc_id, l ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS a,
         {_FOLD_SQL.format("s")} AS normal FROM parts
), units AS (
  SELECT doc_id, l, 0 AS i, a, a + length(line) AS b, normal FROM placed WHERE {_WORDS_SQL.format("normal")} >= {MIN_LINE_WORDS}
  UNION ALL
  SELECT doc_id, l, i, a, a + length(s) AS b, normal FROM sentences WHERE n > 1 AND {_WORDS_SQL.format("normal")} >= {MIN_SENTENCE_WORDS}
), later AS (
  SELECT doc_id, l, i, a, b FROM (SELECT *, rank() OVER (PARTITION BY normal ORDER BY doc_id, a) AS r FROM units) WHERE r > 1
), gone AS (
  SELECT * FROM later x WHERE i = 0 OR NOT EXISTS (SELECT 1 FROM later y WHERE y.doc_id = x.doc_id AND y.l = x.l AND y.i = 0)
), summed AS (
  SELECT doc_id, count(*)::INT AS n_removed, sum(b - a)::BIGINT AS removed_chars, string_agg(a || '-' || b, ';' ORDER BY a) AS removed_spans FROM gone GROUP BY doc_id
), pieces AS (
  SELECT p.doc_id, p.l, coalesce(s.i, 0) AS i, coalesce(s.s, '') AS s FROM placed p JOIN sentences s ON s.doc_id = p.doc_id AND s.l = p.l
  UNION ALL
  SELECT doc_id, l, 1000000, right(line, length(line) - length(body)) FROM placed
), kept AS (
  SELECT doc_id, string_agg(s, '' ORDER BY l, i) AS text FROM pieces x
  WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = x.doc_id AND g.l = x.l AND (g.i = 0 OR g.i = x.i)) GROUP BY doc_id
)
SELECT d.doc_id, coalesce(k.text, '') AS text, coalesce(n_removed, 0)::INT AS n_removed, coalesce(removed_chars, 0)::BIGINT AS removed_chars, coalesce(removed_spans, '') AS removed_spans
FROM docs d LEFT JOIN summed s USING (doc_id) LEFT JOIN kept k USING (doc_id)
"""
