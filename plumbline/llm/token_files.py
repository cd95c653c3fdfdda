"""Token files: Arrow streams of equal-length sequences with masks.

Each file is one Arrow IPC stream whose batches hold two fixed-size-list
columns, ``ids`` and ``mask``.  Memory-mapped, a batch is a view of the file, so
sequence i is reached without copying.  A second stream beside it indexes the
documents (id, number of tokens).  Files are named by task attempt and listed in
a manifest that only committed tasks reach, so a lost executor leaves at most an
unlisted file.
"""

from __future__ import annotations

import gc
import os
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.staging import Workspace

SEQUENCE = 2048
BATCH = 256
TEXTS = 500
READ_TASKS = 20_000
MEMO_ENTRIES = 500_000
_RUNS = re.compile(r"[a-z]+|[0-9]|[^\t-\r\x20a-z0-9]+").findall
MANIFEST = "part int, path string, n_docs long, n_tokens long"


class LibraryEncoder:
    """The tokenizers library on whole texts, its work on each distinct word kept.

    White space is dropped by this vocabulary's own splitter, so the ids of a text
    are those of its parts between spaces and line feeds, one after another.
    A part of ASCII letters and marks falls further into runs of letters, single
    digits and runs of marks; the splitter does the same, and letters are lowered.
    Parts that may hold a special token or an apostrophe go to the library whole.
    """

    def __init__(self, path: str, dtype: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.code = Tokenizer.from_file(path), np.dtype(dtype).char
        self._parts: list[dict[str, bytes]] = [{}, {}]
        self._runs: list[dict[str, bytes]] = [{}, {}]

    def _library(self, runs: list[str]) -> None:
        now = self._runs[0]
        for at in range(0, len(runs), 20_000):
            some = runs[at : at + 20_000]
            for w, e in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False), strict=True):
                now[w] = array(self.code, e.ids).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text.  The many lists made here form no cycles, so the collector does not walk them."""
        collects = gc.isenabled()
        gc.disable()
        try:
            return self._encode(texts)
        finally:
            if collects:
                gc.enable()

    def _encode(self, texts: list[str]) -> list[bytes]:
        for memo in (self._parts, self._runs):
            if len(memo[0]) > MEMO_ENTRIES:
                memo[:] = [{}, memo[0]]
        now, old = self._parts
        runs, old_runs = self._runs
        split = [t.replace("\n", " ").split(" ") for t in texts]
        cut: dict[str, list[str]] = {}
        for part in set().union(*split):
            if part not in now:
                if part in old:
                    now[part] = old[part]
                elif part.isascii() and "<|" not in part and "'" not in part:
                    cut[part] = _RUNS(part.lower())
                else:
                    cut[part] = [part]
        new = set().union(*cut.values())
        for run in [r for r in new if r not in runs and r in old_runs]:
            runs[run] = old_runs[run]
        self._library([r for r in new if r not in runs])
        for part, pieces in cut.items():
            now[part] = runs[pieces[0]] if len(pieces) == 1 else b"".join([runs[r] for r in pieces])
        return [b"".join(map(now.__getitem__, parts)) for parts in split]


_encoders: dict[tuple[str, str], LibraryEncoder] = {}


def library_encoder(path: str, dtype: str) -> LibraryEncoder:
    if (path, dtype) not in _encoders:
        _encoders[path, dtype] = LibraryEncoder(path, dtype)
    return _encoders[path, dtype]


def sequence_schema(dtype: str, length: int) -> pa.Schema:
    kind = pa.from_numpy_dtype(np.dtype(dtype))
    return pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.uint8(), length))])


class SequenceWriter:
    """Packs a stream of ids into equal-length sequences; the last one is padded and masked."""

    def __init__(self, sink, dtype: str, length: int, batch: int = BATCH):
        self.schema, self.dtype, self.length = sequence_schema(dtype, length), np.dtype(dtype), length
        self.writer = pa.ipc.new_stream(sink, self.schema)
        self.buffer = np.zeros(length * batch, self.dtype)
        self.used = 0

    def write(self, ids: np.ndarray) -> None:
        at = 0
        while at < len(ids):
            n = min(len(ids) - at, len(self.buffer) - self.used)
            self.buffer[self.used : self.used + n] = ids[at : at + n]
            at, self.used = at + n, self.used + n
            if self.used == len(self.buffer):
                self._flush()

    def _flush(self) -> None:
        rows = -(-self.used // self.length)
        if rows:
            flat = self.buffer[: rows * self.length].copy()
            flat[self.used :] = 0
            mask = np.zeros(rows * self.length, np.uint8)
            mask[: self.used] = 1
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (flat, mask)]
            self.writer.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))
        self.used = 0

    def close(self) -> None:
        self._flush()
        self.writer.close()


def open_file(path: str):
    """A readable source; a local file is memory-mapped."""
    system, place = pafs.FileSystem.from_uri(path)
    return pa.memory_map(place) if isinstance(system, pafs.LocalFileSystem) else system.open_input_file(place)


def read_sequences(path: str) -> pa.Table:
    """All sequences of a file; for a local file every batch is a view of the mapped bytes."""
    return pa.ipc.open_stream(open_file(path)).read_all()


def sequence(table: pa.Table, i: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and mask of sequence i as views."""
    for batch in table.to_batches():
        if i < batch.num_rows:
            out = []
            for col in (batch.column(0), batch.column(1)):
                n = col.type.list_size
                values = col.values.to_numpy(zero_copy_only=True)
                at = (col.offset + i) * n
                out.append(values[at : at + n])
            return out[0], out[1]
        i -= batch.num_rows
    raise IndexError("no such sequence")


def write_token_files(
    docs: DataFrame,
    tokenizer_path: str,
    folder: str,
    end_id: int,
    dtype: str = "uint16",
    length: int = SEQUENCE,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Range-partitions by id, tokenizes, and writes one file per partition; returns the manifest.

    Documents lie in ascending order of id (nulls first), ties by text.  Texts go
    through the shuffle, not ids: finding the ranges reads its input twice, and
    that must not tokenize twice.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, end = library_encoder(tokenizer_path, dtype), np.array([end_id], dtype).tobytes()
        system, root = pafs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        part = TaskContext.get().partitionId()
        name = f"tokens-{part:06d}-{uuid.uuid4().hex}"
        writer = index = sinks = None
        n_docs = n_tokens = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                sinks = [system.open_output_stream(f"{root}/{name}.{x}") for x in ("arrow", "index")]
                writer = SequenceWriter(sinks[0], dtype, length)
                index = pa.ipc.new_stream(sinks[1], pa.schema([("id", pa.int64()), ("n", pa.int64())]))
            sizes = []
            for at in range(0, batch.num_rows, TEXTS):
                for ids in enc.encode([t or "" for t in batch.column(1).slice(at, TEXTS).to_pylist()]):
                    got = np.frombuffer(ids + end, dtype)
                    writer.write(got)
                    sizes.append(len(got))
            index.write_batch(
                pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(sizes, pa.int64())], names=["id", "n"])
            )
            n_docs, n_tokens = n_docs + len(sizes), n_tokens + sum(sizes)
        if writer is not None:
            writer.close()
            index.close()
            for s in sinks:
                s.close()
            cols = [[part], [f"{folder}/{name}"], [n_docs], [n_tokens]]
            types = [pa.int32(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["part", "path", "n_docs", "n_tokens"]
            )

    return (
        docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
        .repartitionByRange(F.col("id").asc_nulls_first())
        .sortWithinPartitions(F.col("id").asc_nulls_first(), "text")
        .mapInArrow(write, MANIFEST)
    )


def read_documents(manifest: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per document, from the files alone: id, start (ids of all documents before it), n_tokens, ids_crc32.

    The manifest has one row per file; starts are summed over it, in file order.
    """
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.select("path", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("first"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield from _file_rows(path, first, id_col)

    tasks = max(1, min(manifest.count(), READ_TASKS))  # a manifest is small: left to itself it would be one task
    return files.repartition(tasks, "path").mapInArrow(read, f"`{id_col}` long, start long, n_tokens long, ids_crc32 long")


def _file_rows(path: str, start: int, id_col: str) -> Iterator[pa.RecordBatch]:
    def pieces() -> Iterator[np.ndarray]:
        with pa.ipc.open_stream(open_file(f"{path}.arrow")) as stream:
            for batch in stream:
                ids, mask = (c.flatten().to_numpy(zero_copy_only=True) for c in batch.columns)
                yield ids[: np.count_nonzero(mask)]

    source, now = pieces(), np.empty(0, np.uint16)
    with pa.ipc.open_stream(open_file(f"{path}.index")) as index:
        for batch in index:
            crcs, starts = [], []
            for n in batch.column(1).to_pylist():
                crc, left = 0, n
                while left:
                    if not len(now):
                        now = next(source)
                    take = now[:left]
                    crc = zlib.crc32(take.astype("<u4").tobytes(), crc)
                    now, left = now[len(take) :], left - len(take)
                crcs.append(crc)
                starts.append(start)
                start += n
            cols = [batch.column(0), pa.array(starts, pa.int64()), batch.column(1), pa.array(crcs, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=[id_col, "start", "n_tokens", "ids_crc32"])


def token_index(
    docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", work: Workspace | None = None
) -> DataFrame:
    """Writes token files in the shared folder and reads them back, one row per document.

    A null or empty text is its end id alone.  Repeated rows are documents each;
    null ids come first.  An empty table writes no file and gives an empty
    result.  Other columns of ``docs`` are not read.
    """
    work = work or Workspace(docs.sparkSession, "tokens")
    files = write_token_files(docs, tokenizer_path, work.path("files"), end_id, id_col=id_col, text_col=text_col)
    return read_documents(work.stage(files, "manifest"), id_col)


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    return token_index(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, end_id=2)
