"""Best-fit packing of documents into fixed-length sequences by exact-complement hashing.

The planner works on a histogram of piece lengths: at most `capacity` numbers, whatever the corpus. For each open
sequence, longest pieces first, it looks for a combination that fills the gap exactly: a single length, a pair, then a
triple, found in an index of length sums under the current availability counts, and consumes as many such combinations
at once as the counts allow. Only when none is left does it place the best-fitting (longest that fits) piece and look
again for an exact complement of the gap that remains.

The plan is a table of runs: "the pieces numbered r0 .. r0+n-1 of length L go to sequences s0 .. s0+n-1 at offset o".
Pieces get their number within their length from per-partition histograms (partitions x capacity small rows), so no
length, however common, is ever gathered in one task.

Defined results: a null text is an empty one, which is its end id alone; texts longer than the capacity are cut into
full pieces with a shorter last one; repeated rows are packed as often as they occur; an empty table gives an empty
result; columns other than id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from lexloom.llm.common import lean, materialise, text_of
from lexloom.llm.tokens import encoder, resolve

CAPACITY = 2048
END_ID = 0


# ---- planning on the histogram ---------------------------------------------------------------------------------


class Sums:
    """Availability counts by length, and an index of the single, pair and triple sums of available lengths that follows them."""

    def __init__(self, counts: np.ndarray):
        self.counts = counts
        self.alive = np.zeros(len(counts), dtype=bool)
        # By sum: how many pairs and triples of available lengths (a length may stand twice or thrice) make it.
        self.pairs = np.zeros(2 * len(counts), dtype=np.int64)
        self.triples = np.zeros(len(counts), dtype=np.int64)
        for x in np.flatnonzero(counts):
            self._turn(int(x), 1)

    def _turn(self, x: int, sign: int) -> None:
        """A length becomes available or runs out: the pairs and triples that it is part of come or go."""
        size = len(self.triples) - x
        if sign > 0:
            self.alive[x] = True
        else:
            self.triples[x:] -= self.pairs[:size]
        self.pairs[x + np.flatnonzero(self.alive)] += sign
        if sign > 0:
            self.triples[x:] += self.pairs[:size]
        else:
            self.alive[x] = False

    def add(self, x: int, n: int) -> None:
        self.counts[x] += n
        if (self.counts[x] > 0) != self.alive[x]:
            self._turn(x, 1 if n > 0 else -1)

    def exact(self, gap: int) -> list[int] | None:
        """Lengths (one, two or three, longest first) that fill the gap exactly and are available together; None if there are none."""
        counts = self.counts
        if gap <= 0:
            return None
        if counts[gap] > 0:
            return [gap]
        have = np.flatnonzero(self.alive[: gap + 1])
        if not len(have):
            return None
        if self.pairs[gap]:
            low = have[have * 2 <= gap]
            other = gap - low
            ok = (counts[other] > 0) & ((other != low) | (counts[low] > 1))
            if ok.any():
                x = int(low[np.flatnonzero(ok)[-1]])  # the pair nearest to halves keeps long and short pieces for other gaps
                return [gap - x, x]
        if not self.triples[gap]:
            return None
        # Triples x <= y <= z: where the pair index has the complement of x; the counts decide. Longest x first.
        third = have[have * 3 <= gap]
        for x in third[self.pairs[gap - third] > 0][::-1]:
            x = int(x)
            rest = gap - x
            y = have[(have >= x) & (have * 2 <= rest)]
            z = rest - y
            need_x = 1 + (y == x) + (z == x)
            ok = (counts[z] > 0) & (counts[x] >= need_x) & ((y != z) | (counts[y] >= 2 + (y == x)))
            if ok.any():
                y = int(y[np.flatnonzero(ok)[-1]])
                return [rest - y, y, x]
        return None

    def best(self, gap: int) -> int | None:
        """The longest available length that fits."""
        fitting = np.flatnonzero(self.alive[: gap + 1])
        return int(fitting[-1]) if len(fitting) else None


def plan_runs(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first number, how many, first sequence, offset) that place every piece once; gapless from 0 in each sequence."""
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in histogram.items():
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of {length} tokens doesn't fit into {capacity}")
        counts[length] += n
    sums = Sums(counts)
    used = np.zeros(capacity + 1, dtype=np.int64)
    runs: list[tuple[int, int, int, int, int]] = []
    sequence = 0
    top = capacity
    while True:
        while top > 0 and counts[top] == 0:
            top -= 1
        if top == 0:
            return runs
        pattern = [top]
        sums.add(top, -1)  # held back while its complement is looked for
        gap = capacity - top
        while gap > 0:
            found = sums.exact(gap)
            if found is None:
                fits = sums.best(gap)
                if fits is None:
                    break
                found = [fits]
            for x in found:
                sums.add(x, -1)
            pattern += found
            gap -= sum(found)
        lengths, times = np.unique(pattern, return_counts=True)
        more = int((counts[lengths] // times).min())  # the same combination again, as often as the counts allow
        if more:
            for x, n in zip(lengths, times, strict=True):
                sums.add(int(x), -more * int(n))
        offset = 0
        n = more + 1
        for x in pattern:
            # Numbers of one length are used up in order; an equal length in the same sequence takes the next n numbers.
            runs.append((x, int(used[x]), n, sequence, offset))
            used[x] += n
            offset += x
        sequence += n


# ---- pieces ----------------------------------------------------------------------------------------------------


def tokenize_pieces(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", capacity: int = CAPACITY, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text", with_ids: bool = True, ranked: bool = False) -> DataFrame:
    """Per piece: doc_id, piece (int, from 0), start (long, ids before it in its document), length (long), ids_crc32 (long,
    unsigned, of the little-endian unsigned 32-bit ids), ids (binary, if with_ids); with `ranked` also what pack_best_fit
    adds to its rows, in the same pass over the text."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("text"))
    fields = [rows.schema["doc_id"], StructField("piece", IntegerType()), StructField("start", LongType()), StructField("length", LongType()), StructField("ids_crc32", LongType())]
    schema = StructType(fields + [StructField("ids", BinaryType())] * with_ids + [StructField(c, LongType()) for c in RANK] * ranked)

    def run(batches: Iterator) -> Iterator:
        from zlib import crc32

        import pyarrow as pa
        from pyspark import TaskContext

        enc = encoder(resolve(tokenizer))
        end = np.asarray([end_id], dtype="<u4").tobytes()
        step = 4 * capacity
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, dtype=np.int64)

        def emit(kind, keys, places, sums, ids):
            at = np.array(places, dtype=np.int64).reshape(-1, 3)
            columns = [pa.array(keys, kind), pa.array(at[:, 0].astype(np.int32)), pa.array(at[:, 1].copy()), pa.array(at[:, 2].copy()), pa.array(sums, pa.int64())]
            if with_ids:
                columns.append(pa.array(ids, pa.binary()))
            if ranked:
                columns += [pa.array(np.full(len(at), part)), pa.array(_ranks(at[:, 2], seen))]
            return pa.RecordBatch.from_arrays(columns, names=schema.names)

        for batch in batches:
            keys_of, out, held = batch.column(0), ([], [], [], []), 0
            for row, found in zip(keys_of, enc.encode_column(batch.column(1)), strict=True):
                ids, key = found.tobytes() + end, row.as_py()
                for k in range(0, len(ids), step):
                    piece = ids[k : k + step]
                    for col, value in zip(out, (key, (k // step, k // 4, len(piece) // 4), crc32(piece), piece if with_ids else None), strict=True):
                        col.append(value)
                    held += len(piece) if with_ids else 64
                if held > 8 << 20:
                    yield emit(keys_of.type, *out)
                    out, held = ([], [], [], []), 0
            if out[0]:
                yield emit(keys_of.type, *out)

    return rows.mapInArrow(lean(run), schema)


#: A piece's place among the rows of its length: the number of the task that wrote it, and its rank there.
RANK = ("__ll_part", "__ll_k")


def _ranks(lengths: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """For each row, how many earlier rows have its length; seen (by length) is carried on."""
    order = np.argsort(lengths, kind="stable")
    run = lengths[order]
    first = np.searchsorted(run, run, side="left")
    out = np.empty(len(lengths), dtype=np.int64)
    out[order] = np.arange(len(run)) - first + seen[run]
    seen += np.bincount(lengths, minlength=len(seen))
    return out


def pack_best_fit(pieces: DataFrame, capacity: int = CAPACITY, length: str = "length") -> DataFrame:
    """pieces' columns plus sequence_id (long, from 0) and offset (long). Any table with a length column from 1 to capacity can be packed.

    pieces are written once to the shared folder, each row with its task's number and its rank among the task's rows of
    that length; both stay fixed from then on, also when an executor is lost. Columns named like the new ones are
    replaced.
    """
    pieces = pieces.drop("sequence_id", "offset")
    ranked = StructType([*pieces.schema.fields, *[StructField(c, LongType()) for c in RANK]])

    def rank(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, dtype=np.int64)
        for batch in batches:
            lengths = batch.column(batch.schema.get_field_index(length)).to_numpy(zero_copy_only=False).astype(np.int64)
            k = _ranks(lengths, seen)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(k), part)), pa.array(k)], names=[*batch.schema.names, *RANK])

    return _place(materialise(pieces.mapInArrow(lean(rank), ranked), "pieces"), capacity, length)


def _place(written: DataFrame, capacity: int, length: str) -> DataFrame:
    """written: a table of ranked pieces. Plan on its histogram, and give each piece its place."""
    fields = [f for f in written.schema.fields if f.name not in RANK]
    per_part = written.groupBy(F.col(RANK[0]).alias("__ll_p"), F.col(length).cast("bigint").alias("__ll_len")).agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["__ll_len"]: r["n"] for r in per_part.groupBy("__ll_len").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    runs = np.asarray(sorted(plan_runs(histogram, capacity)), dtype=np.int64).reshape(-1, 5)
    before = Window.partitionBy("__ll_len").orderBy("__ll_p").rowsBetween(Window.unboundedPreceding, -1)
    bases = per_part.select("__ll_p", "__ll_len", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__ll_base"))
    based = written.join(bases, (F.col(RANK[0]) == F.col("__ll_p")) & (F.col(length) == F.col("__ll_len")))
    numbered = based.select(*[F.col(f.name) for f in fields], (F.col("__ll_base") + F.col(RANK[1])).alias("__ll_number"))
    placed = StructType([*fields, StructField("sequence_id", LongType()), StructField("offset", LongType())])
    key = runs[:, 0] << 44 | runs[:, 1]  # (length, first number): sorted

    def place(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            lengths = batch.column(batch.schema.get_field_index(length)).to_numpy(zero_copy_only=False).astype(np.int64)
            number = batch.column(batch.num_columns - 1).to_numpy()
            run = runs[np.searchsorted(key, lengths << 44 | number, side="right") - 1]
            new = [pa.array(run[:, 3] + number - run[:, 1]), pa.array(run[:, 4])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *new], names=[*batch.schema.names[:-1], "sequence_id", "offset"])

    return numbered.mapInArrow(lean(place), placed)


def pack_documents(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", capacity: int = CAPACITY, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Tokenise, cut and pack: doc_id, piece, start, length, ids_crc32 (and ids), sequence_id, offset."""
    pieces = tokenize_pieces(docs, tokenizer, capacity, end_id, doc_id, text, with_ids, ranked=True)
    return _place(materialise(pieces, "pieces"), capacity, "length")
