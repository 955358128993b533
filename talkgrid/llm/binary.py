"""Token ids as Arrow files of equal-length sequences.

Texts are encoded with a public tokenizer, an end id follows each, and the ids are written in ascending id order
(rows without an id last, equal ids by text) to Arrow IPC files: one fixed-size list of ``length`` ids and one of
``length`` mask bits per sequence, in record batches of a fixed number of sequences. A memory-mapped reader finds
sequence ``i`` by arithmetic, without copying. Ids are 16 bits wide where the vocabulary allows, else 32. The last sequence of a file is filled up with zeros whose mask is 0.
Next to each file lies its index, one row per text, so a text is found by its place in the stream.

Every file is written by one task under a name of its own and renamed when complete; a repeated task writes the same
bytes again. ``pyarrow.fs`` opens the folder, so it may lie in any store that it knows.
"""

from __future__ import annotations

import uuid
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .bytelevel import ByteLevel
from .common import new_folder, pieces_of_batch, table, text_or_empty
from .pieces import model_bytes

def id_type(vocabulary: int) -> pa.DataType:
    """The narrowest unsigned type that holds every id."""
    return pa.uint16() if vocabulary <= 1 << 16 else pa.uint32()


def _sequence_schema(length: int, kind: pa.DataType) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.field("item", kind, nullable=False), length)), ("mask", pa.list_(pa.field("item", pa.bool_(), nullable=False), length))])


INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


@lru_cache(maxsize=2)
def byte_encoder(model: bytes) -> ByteLevel:
    """One per Python worker and model."""
    return ByteLevel(model, special=True)


def _open(folder: str):
    from pyarrow import fs
    return fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


class SequenceWriter:
    """Writes ids to one file, ``rows`` sequences a batch; holds at most one batch."""

    def __init__(self, filesystem, path: str, length: int, rows: int, kind: pa.DataType):
        self.fs, self.path, self.length, self.rows = filesystem, path, length, rows
        self.kind = kind
        self.schema = _sequence_schema(length, kind)
        self.draft = f"{path}.{uuid.uuid4().hex}"
        self.sink = filesystem.open_output_stream(self.draft)
        self.file = pa.ipc.new_file(self.sink, self.schema)
        self.held: list[np.ndarray] = []
        self.size = self.total = 0

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids)
        self.size += len(ids)
        self.total += len(ids)
        block = self.length * self.rows
        if self.size >= block:
            flat = np.concatenate(self.held)
            for i in range(0, len(flat) - block + 1, block):
                self._batch(flat[i:i + block], block)
            rest = flat[len(flat) - len(flat) % block:]
            self.held, self.size = [rest], len(rest)

    def _batch(self, flat: np.ndarray, real: int) -> None:
        mask = np.arange(len(flat)) < real
        arrays = [pa.FixedSizeListArray.from_arrays(pa.array(v, k), type=f.type) for v, k, f in ((flat.astype(self.kind.to_pandas_dtype(), copy=False), self.kind, self.schema.field(0)), (mask, pa.bool_(), self.schema.field(1)))]
        self.file.write_batch(pa.RecordBatch.from_arrays(arrays, schema=self.schema))

    def close(self) -> None:
        if self.size:
            flat = np.concatenate(self.held)
            short = -len(flat) % self.length
            self._batch(np.concatenate((flat, np.zeros(short, np.uint32))), self.size)
        self.file.close()
        self.sink.close()
        self.fs.move(self.draft, self.path)


class SequenceReader:
    """Random access to one file: ``ids(start, n)`` and ``sequence(i)``; memory-mapped where the store is local."""

    def __init__(self, filesystem, path: str):
        from pyarrow import fs
        self.source = pa.memory_map(path) if isinstance(filesystem, fs.LocalFileSystem) else filesystem.open_input_file(path)
        self.file = pa.ipc.open_file(self.source)
        self.length = self.file.schema.field("ids").type.list_size
        self.rows = self.file.get_batch(0).num_rows if self.file.num_record_batches else 1
        self.at, self.now = -1, None

    def batch(self, b: int) -> np.ndarray:
        if b != self.at:
            self.at, self.now = b, self.file.get_batch(b).column(0).flatten().to_numpy()
        return self.now

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        batch, row = self.file.get_batch(i // self.rows), i % self.rows
        return tuple(c.slice(row, 1).flatten().to_numpy(zero_copy_only=False) for c in batch.columns)

    def ids(self, start: int, n: int):
        """The pieces of the stream from ``start``, ``n`` ids in all, batch by batch."""
        block = self.length * self.rows
        while n > 0:
            b, i = divmod(start, block)
            got = self.batch(b)[i:i + n]
            yield got
            start, n = start + len(got), n - len(got)


def write_sequences(docs: DataFrame, folder: str, model_path: str, text: str = "text", key: str = "doc_id", end_id: int = 2,
                    length: int = 2048, rows: int = 64, files: int | None = None) -> DataFrame:
    """Writes ``docs`` to ``folder`` and returns one row per file, written once: ``(file, ids, texts)``.

    Null and empty texts give just the end id. Rows are dealt to files by range of ``(key, hash of the text)``, so
    neither a repeated key nor a hot source fills one file; more columns are ignored.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model_bytes(model_path))
    n = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    d = docs.select(F.col(key).cast("bigint").alias("k"), text_or_empty(text).alias("x"))
    order = [F.col("k").asc_nulls_last(), F.xxhash64("x"), F.col("x")]
    d = d.repartitionByRange(n, *order[:2]).sortWithinPartitions(*order).withColumn("p", F.spark_partition_id())

    def run(batches):
        filesystem, root = _open(folder)
        encoder = byte_encoder(sent.value)
        data = index = None
        texts = 0
        for whole in batches:
            for b in pieces_of_batch(whole, 256):
                if data is None:
                    filesystem.create_dir(root, recursive=True)
                    name = f"part-{b.column(2)[0].as_py():06d}"
                    data = SequenceWriter(filesystem, f"{root}/{name}.arrow", length, rows, id_type(max(encoder.size, end_id + 1)))
                    index_draft = f"{root}/{name}.index.{uuid.uuid4().hex}"
                    index_sink = filesystem.open_output_stream(index_draft)
                    index = pa.ipc.new_file(index_sink, INDEX)
                got = [np.array([*ids, end_id], np.uint32) for ids in encoder.encode(b.column(1).to_pylist())]
                sizes = np.array([len(g) for g in got], np.int64)
                starts = data.total + np.cumsum(sizes) - sizes
                index.write_batch(pa.RecordBatch.from_arrays([b.column(0), pa.array(starts), pa.array(sizes)], schema=INDEX))
                data.add(np.concatenate(got))
                texts += len(got)
        if data is not None:
            data.close()
            index.close()
            index_sink.close()
            filesystem.move(index_draft, f"{root}/{name}.index.arrow")
            yield pa.RecordBatch.from_pydict({"file": [name], "ids": [data.total], "texts": [texts]}, schema=pa.schema([("file", pa.string()), ("ids", pa.int64()), ("texts", pa.int64())]))

    made = d.mapInArrow(run, "file string, ids bigint, texts bigint")
    listing = f"{folder}/files"
    made.write.parquet(listing)
    return spark.read.schema(made.schema).parquet(listing)


def read_sequences(spark: SparkSession, folder: str, files: DataFrame) -> DataFrame:
    """One row per text from the files: ``(doc_id, start, n_tokens, ids_crc32)``; ``start`` counts the ids of all texts before it."""
    # one row per file: its place in the stream is a sum over the list of files
    listed = [(r.file, r.ids) for r in files.orderBy("file").select("file", "ids").toLocalIterator()]
    base, rows = 0, []
    for name, ids in listed:
        rows.append((name, base))
        base += ids
    d = spark.createDataFrame(rows, "file string, base bigint").repartition(max(1, len(rows)), "file")
    out = pa.schema([*INDEX, ("ids_crc32", pa.int64())])

    def run(b: pa.RecordBatch):
        filesystem, root = _open(folder)
        for name, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            data = SequenceReader(filesystem, f"{root}/{name}.arrow")
            with filesystem.open_input_file(f"{root}/{name}.index.arrow") as f:
                index = pa.ipc.open_file(f)
                for i in range(index.num_record_batches):
                    part = index.get_batch(i)
                    starts, sizes = part.column(1).to_numpy(), part.column(2).to_numpy()
                    crcs = []
                    for s, n in zip(starts.tolist(), sizes.tolist()):
                        crc = 0
                        for ids in data.ids(s, n):
                            crc = zlib.crc32(ids.astype("<u4", copy=False), crc)
                        crcs.append(crc)
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(starts + base), part.column(2), pa.array(crcs, pa.int64())], schema=out)

    def each(batches):
        for b in batches:
            yield from run(b)

    return d.mapInArrow(each, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def byte_model() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def op8_query(spark: SparkSession, sf_dir: str, model_path: str | None = None) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    folder = new_folder(spark, "sequences")
    files = write_sequences(docs, folder, model_path or byte_model())
    return read_sequences(spark, folder, files)
