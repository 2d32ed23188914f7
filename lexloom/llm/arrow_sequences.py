"""Token-id output: Arrow stream files of equal-length sequences and masks, read back without copying.

Documents are range-partitioned by doc_id and sorted; each partition is encoded and streamed to one Arrow file whose
record batches hold `ids` (fixed-size list of unsigned 16-bit integers) and `mask` (fixed-size list of booleans, one
bit an id, false for padding). Documents run on from one sequence to the next; a file's last sequence is padded. Since every
batch but the last has `BATCH` sequences, the place of any id in the file is plain arithmetic, and a memory map gives
sequence, mask or document as views of the mapped bytes.

Files are written under another name and then moved, so that a task run twice leaves one whole file. The index holds
a row for each document: file, place in the file, length. Only file totals (a row for each file) are summed in order.

Defined cases: null text is empty and gives the end id alone; repeated rows are written again; ties of doc_id go by
text; an empty table gives an empty result; other columns are ignored; a null doc_id comes first.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, partitions_by_size, shared_dir, slices, stored
from .tokenise import SLICE_BYTES, encoder, vocabulary_path

#: Ids of a sequence, sequences of a record batch, and the id that ends each document.
LENGTH, BATCH, END = 2048, 256, 2
VOCABULARY = "byte_bpe_50k.json"
_INDEX = "file string, place long, doc_id long, local_start long, n_tokens long"


def _filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI or path, and the path in it."""
    return (pafs.LocalFileSystem(), uri) if "://" not in uri and not uri.startswith("file:") else pafs.FileSystem.from_uri(uri.replace("file:///", "file:/").replace("file:/", "file:///", 1))


def schema(length: int = LENGTH) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.uint16(), length)), ("mask", pa.list_(pa.bool_(), length))])


class SequenceFile:
    """Writes a stream of ids as an Arrow stream file of fixed-size-list batches."""

    def __init__(self, sink, length: int = LENGTH, batch: int = BATCH):
        self.length, self.size, self.left = length, length * batch * 2, bytearray()
        self.writer = pa.ipc.new_stream(sink, schema(length))

    def _batch(self, data: bytes, real: int) -> None:
        ids = pa.Array.from_buffers(pa.uint16(), len(data) // 2, [None, pa.py_buffer(data)])
        mask = np.arange(len(data) // 2) < real
        self.writer.write_batch(pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(ids, self.length), pa.FixedSizeListArray.from_arrays(pa.array(mask), self.length)], schema=schema(self.length)))

    def add(self, data: bytes) -> None:
        self.left += data
        while len(self.left) >= self.size:
            self._batch(bytes(self.left[: self.size]), self.size // 2)
            del self.left[: self.size]

    def close(self) -> None:
        if self.left:
            real = len(self.left) // 2
            self._batch(bytes(self.left.ljust(-(-real // self.length) * self.length * 2, b"\0")), real)
        self.writer.close()


class SequenceReader:
    """Random access to a sequence file: views of the mapped or read bytes, no copies."""

    def __init__(self, uri: str):
        fs, path = _filesystem(uri)
        source = pa.memory_map(path) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(path)
        self.batches = list(pa.ipc.open_stream(source))
        self.length = self.batches[0].schema.field("ids").type.list_size if self.batches else LENGTH
        self.per_batch = self.batches[0].num_rows if self.batches else 1

    def _flat(self, batch: int) -> np.ndarray:
        return self.batches[batch].column(0).flatten().to_numpy(zero_copy_only=True)

    def sequence(self, i: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """Ids and mask of sequence i."""
        b, at = divmod(i, self.per_batch)
        ids = self._flat(b)[at * self.length : (at + 1) * self.length]
        return ids, self.batches[b].column(1).flatten().slice(at * self.length, self.length)

    def span(self, start: int, n: int) -> list[np.ndarray]:
        """Views of n ids from place `start`, one for each record batch that they touch."""
        size, out = self.per_batch * self.length, []
        while n > 0:
            b, at = divmod(start, size)
            out.append(self._flat(b)[at : at + n])
            start, n = start + len(out[-1]), n - len(out[-1])
        return out


def write_sequences(docs: DataFrame, path: str | None = None, folder: str | None = None, length: int = LENGTH, end: int = END) -> DataFrame:
    """Writes the files and gives their index: file, place (of the file), doc_id, local_start, n_tokens."""
    spark = docs.sparkSession
    path, folder = path or vocabulary_path(VOCABULARY), folder or shared_dir(spark, "sequences")
    plain = documents(docs, "doc_id", "text")
    # A file for each partition: as many as the session asks for, or more where the table is large.
    ordered = plain.repartitionByRange(partitions_by_size(plain), F.col("doc_id")).sortWithinPartitions("doc_id", "text")
    mark = np.array([end], np.uint16).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = TaskContext.get().partitionId()
        fs, base = _filesystem(folder)
        fs.create_dir(base, recursive=True)
        name, draft = f"{base}/part-{place:06d}.arrow", f"{base}/.part-{place:06d}-{TaskContext.get().taskAttemptId()}"
        encode, at = encoder(path).encode, 0
        with fs.open_output_stream(draft) as sink:
            file = SequenceFile(sink, length)
            for batch in slices(batches, limit=SLICE_BYTES):
                starts, sizes = [], []
                for data in encode(batch.column(1)):
                    file.add(data + mark)
                    starts.append(at)
                    sizes.append(len(data) // 2 + 1)
                    at += sizes[-1]
                n = len(starts)
                yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/part-{place:06d}.arrow"] * n), pa.array([place] * n, pa.int64()), batch.column(0), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64())], names=["file", "place", "doc_id", "local_start", "n_tokens"])
            file.close()
        fs.move(draft, name)

    return stored(ordered.mapInArrow(run, _INDEX), "sequence-index")


def read_sequences(index: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files' bytes."""
    upto = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    base = index.groupBy("place").agg(F.sum("n_tokens").alias("total")).withColumn("base", F.coalesce(F.sum("total").over(upto), F.lit(0))).select("place", "base")
    placed = index.join(F.broadcast(base), "place")  # a row for each file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, reader = None, None
        for batch in batches:
            rows = []
            for file, doc_id, base_, local, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if file != name:
                    name, reader = file, SequenceReader(file)
                crc = 0
                for view in reader.span(local, n):
                    crc = zlib.crc32(view.astype("<u4").tobytes(), crc)
                rows.append((doc_id, base_ + local, n, crc))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return placed.select("file", "doc_id", "base", "local_start", "n_tokens").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    return read_sequences(write_sequences(docs, path))
