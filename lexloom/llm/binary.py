"""Token ids as Arrow files: one stream of ids in ascending document order, cut into equal-length sequences.

Each task writes one pair of Arrow IPC files in the shared folder: `part-N.tokens.arrow` with record batches of
FixedSizeList<ids>[length] and FixedSizeList<bool>[length] (the mask; false only on the padding at a file's end), and
`part-N.index.arrow` with doc_id, start in the file and n_tokens. All sequences have one size, so sequence k of a file
lies at a computed place: readers map the file and take it without copying or decoding. Ids are stored as uint16 where
the vocabulary allows it, else as uint32.

Documents are dealt by ranges of their id and, among equal ids, of a hash of their text, so the files in order hold the
corpus in order; a range is a fixed share of the rows, and only rows that repeat both are kept together. A task that runs
again writes the same files and puts them in place of the former ones (write to a name of its own, then move), so lost
executors and speculation do no harm.

Defined results: a null text is an empty one (its end id alone); rows with a null id come first; repeated rows are
stored as often as they occur, rows of one id by the hash of their text; an empty table writes no file; columns other than id and text are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import lean, scratch, text_of
from lexloom.llm.tokens import encoder, resolve

LENGTH = 2048
END_ID = 1
#: Sequences in a record batch.
BATCH = 64


def open_store(folder: str):
    """The folder's file system (local, HDFS, S3, GCS by its scheme) and its path there."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


class SequenceWriter:
    """Appends ids to one part; holds at most one record batch of them."""

    def __init__(self, folder: str, part: str, attempt: str, length: int, wide: bool, doc_type):
        import pyarrow as pa

        self.pa, self.length, self.dtype = pa, length, "<u4" if wide else "<u2"
        self.fs, base = open_store(folder)
        self.fs.create_dir(base, recursive=True)
        self.names = {k: (f"{base}/{part}.{k}.arrow", f"{base}/_{attempt}.{part}.{k}.arrow") for k in ("tokens", "index")}
        self.schema = pa.schema([pa.field("ids", pa.list_(pa.uint32() if wide else pa.uint16(), length)), pa.field("mask", pa.list_(pa.bool_(), length))])
        self.index_schema = pa.schema([("doc_id", doc_type), ("start", pa.int64()), ("n_tokens", pa.int64())])
        self.out = {k: self.fs.open_output_stream(tmp) for k, (_, tmp) in self.names.items()}
        self.tokens = pa.ipc.new_file(self.out["tokens"], self.schema)
        self.index = pa.ipc.new_file(self.out["index"], self.index_schema)
        self.held, self.n_held, self.total, self.docs, self.entries = [], 0, 0, 0, [[], [], []]

    def add(self, doc_id, ids: np.ndarray) -> None:
        for col, v in zip(self.entries, (doc_id, self.total, len(ids)), strict=True):
            col.append(v)
        self.total += len(ids)
        self.docs += 1
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= BATCH * self.length:
            self._flush(False)
        if len(self.entries[0]) >= 10_000:
            self._flush_index()

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, self.dtype)
        at, step = 0, BATCH * self.length
        while len(ids) - at >= step or (last and at < len(ids)):
            part = ids[at : at + step]
            at += len(part)
            real = len(part)
            part = np.pad(part, (0, -real % self.length)).astype(self.dtype)
            mask = np.arange(len(part)) < real
            columns = [self.pa.FixedSizeListArray.from_arrays(self.pa.array(x), self.length) for x in (part, mask)]
            self.tokens.write_batch(self.pa.RecordBatch.from_arrays(columns, schema=self.schema))
        self.held, self.n_held = ([ids[at:]], len(ids) - at) if at < len(ids) else ([], 0)

    def _flush_index(self) -> None:
        if self.entries[0]:
            self.index.write_batch(self.pa.RecordBatch.from_arrays([self.pa.array(c, f.type) for c, f in zip(self.entries, self.index_schema, strict=True)], schema=self.index_schema))
            self.entries = [[], [], []]

    def close(self) -> None:
        self._flush(True)
        self._flush_index()
        self.tokens.close()
        self.index.close()
        for k, (final, tmp) in self.names.items():
            self.out[k].close()
            if self.fs.get_file_info(final).is_file:  # a task that ran before wrote the same; not every store moves onto a file
                self.fs.delete_file(final)
            self.fs.move(tmp, final)


def write_sequences(docs: DataFrame, folder: str, tokenizer: str = "word_bpe_49k.json", length: int = LENGTH, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the files and return their manifest: part (int, in order), docs, n_tokens and start (long: ids in the parts before)."""
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("text"))
    order = ["doc_id", F.xxhash64("text")]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        task, writer = TaskContext.get(), None
        enc = encoder(resolve(tokenizer))
        wide = enc.tok.get_vocab_size(with_added_tokens=True) > 65536
        for batch in batches:
            if batch.num_rows and writer is None:
                writer = SequenceWriter(folder, f"part-{task.partitionId():06d}", f"{task.taskAttemptId()}", length, wide, batch.column(0).type)
            for key, ids in zip(batch.column(0), enc.encode_column(batch.column(1)), strict=True):
                writer.add(key.as_py(), np.append(ids, np.uint32(end_id)).astype(writer.dtype))
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pylist([{"part": task.partitionId(), "docs": writer.docs, "n_tokens": writer.total}], pa.schema([("part", pa.int32()), ("docs", pa.int64()), ("n_tokens", pa.int64())]))

    parts = sorted(tuple(r) for r in ordered.mapInArrow(lean(run), "part int, docs bigint, n_tokens bigint").collect())  # a row per file
    start, manifest = 0, []
    for part, n_docs, n in parts:
        manifest.append((part, n_docs, n, start))
        start += n
    return spark.createDataFrame(manifest, "part int, docs bigint, n_tokens bigint, start bigint")


def open_part(folder: str, part: int, kind: str = "tokens"):
    """An Arrow reader over a part's file: mapped into memory on local and mounted folders, else read by ranges."""
    import pyarrow as pa
    from pyarrow import fs

    store, base = open_store(folder)
    path = f"{base}/part-{part:06d}.{kind}.arrow"
    source = pa.memory_map(path) if isinstance(store, fs.LocalFileSystem) else store.open_input_file(path)
    return pa.ipc.open_file(source)


def sequence(reader, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence k of an opened part: its ids (a view of the mapped file) and its mask."""
    batch = reader.get_batch(k // BATCH)
    length = batch.schema.field("ids").type.list_size
    at = k % BATCH * length
    ids = batch.column(0).flatten().to_numpy()[at : at + length]
    return ids, batch.column(1).flatten().slice(at, length).to_numpy(zero_copy_only=False)


def _span(reader, start: int, n: int, length: int) -> list[np.ndarray]:
    """Views of ids start .. start+n-1 of a part, in pieces of at most one record batch."""
    out, step = [], BATCH * length
    while n > 0:
        view = reader.get_batch(start // step).column(0).flatten().to_numpy()[start % step : start % step + n]
        out.append(view)
        start += len(view)
        n -= len(view)
    return out


def read_documents(manifest: DataFrame, folder: str, length: int = LENGTH, doc_type: str = "bigint") -> DataFrame:
    """From the files alone, per document: doc_id, start (long, ids of all documents before it), n_tokens (long), ids_crc32 (long, of the ids as unsigned 32-bit)."""
    schema = f"doc_id {doc_type}, start bigint, n_tokens bigint, ids_crc32 bigint"

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for row in batch.to_pylist():
                tokens, index = open_part(folder, row["part"]), open_part(folder, row["part"], "index")
                for b in range(index.num_record_batches):
                    entries = index.get_batch(b)
                    crcs = []
                    for start, n in zip(entries.column(1).to_pylist(), entries.column(2).to_pylist(), strict=True):
                        crc = 0
                        for view in _span(tokens, start, n, length):
                            crc = zlib.crc32(view.astype("<u4").tobytes(), crc)
                        crcs.append(crc)
                    starts = pa.array(entries.column(1).to_numpy() + row["start"])
                    yield pa.RecordBatch.from_arrays([entries.column(0), starts, entries.column(2), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    n = max(1, manifest.count())
    return manifest.repartition(n, "part").mapInArrow(lean(run), schema)


def round_trip(docs: DataFrame, folder: str | None = None, **settings) -> DataFrame:
    """Write docs' ids to the files and return what reading them back gives."""
    folder = folder or scratch(docs.sparkSession, "tokens")
    kind = docs.schema[settings.get("doc_id", "doc_id")].dataType.simpleString()
    manifest = write_sequences(docs, folder, **settings)
    return read_documents(manifest, folder, settings.get("length", LENGTH), kind)
