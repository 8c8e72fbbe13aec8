"""Documents in chunks: one row for some megabytes of text, kept compressed.

Operators that look at all n-grams of a corpus would shuffle a row for each n-gram.
Here a chunk sends packed numbers (see exchange), and meets its answers by a cogroup.
The size of chunks bounds the memory of every task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkspark.llm import common
from linkspark.operators.storage import materialize

CHUNK_BYTES = 16 << 20
CHUNKS = "chunk long, n_docs long, n_bytes long, ids binary, lengths binary, text binary, extra binary"


def pack(values: np.ndarray) -> bytes:
    """Compressed bytes of an array."""
    raw = np.ascontiguousarray(values).tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(blob: bytes, dtype) -> np.ndarray:
    size = int.from_bytes(blob[:8], "little")
    return np.frombuffer(pa.decompress(blob[8:], size, codec="zstd", asbytes=True) if size else b"", dtype)


def chunked(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", extra: F.Column | None = None, chunk_bytes: int = CHUNK_BYTES, carry: tuple[str, ...] = ()) -> DataFrame:
    """Chunks of the rows (null text: empty), written to the shared folder.  extra: a long carried for each row, or carry: columns kept as they are."""
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"), (F.lit(0) if extra is None else extra).cast("long").alias("extra"), *[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(carry)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, made = TaskContext.get().partitionId() << 32, 0
        for batch in common.steps(batches, "text", chunk_bytes):
            offsets, data = common.bytes_of(batch.column("text"))
            ids = np.asarray(pc.fill_null(batch.column("id"), np.iinfo(np.int64).max))
            row = [base + made, batch.num_rows, int(offsets[-1]), pack(ids), pack(np.diff(offsets)), pack(data), serialize(batch, len(carry)) if carry else pack(np.asarray(batch.column("extra")))]
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64() if isinstance(x, int) else pa.binary()) for x in row], names=[x.split()[0] for x in CHUNKS.split(", ")])
            made += 1

    return materialize(rows.mapInArrow(common.lean(run), CHUNKS))


def serialize(batch: pa.RecordBatch, carried: int) -> bytes:
    columns = batch.select([f"_{i}" for i in range(carried)])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, columns.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(columns)
    return sink.getvalue().to_pybytes()


def deserialize(blob: bytes) -> pa.RecordBatch:
    with pa.ipc.open_stream(blob) as source:
        return source.read_next_batch()


class Chunk:
    """A chunk's rows: ids (null: the greatest long), starts of texts and the end, bytes."""

    def __init__(self, row: dict):
        self.key = row["chunk"]
        self.ids = unpack(row["ids"], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(unpack(row["lengths"], np.int64))])
        self.data = unpack(row["text"], np.uint8)
        self.blob = row["extra"]

    @property
    def extra(self) -> np.ndarray:
        return unpack(self.blob, np.int64)

    def steps(self, limit: int) -> Iterator[tuple[int, int]]:
        """Ranges of rows with about `limit` bytes each."""
        at, n = 0, len(self.ids)
        while at < n:
            to = max(int(np.searchsorted(self.starts, self.starts[at] + limit, "right")) - 1, at + 1)
            yield at, min(to, n)
            at = to

    def texts(self, a: int, b: int) -> pa.Array:
        """Texts of rows a to b."""
        offsets = self.starts[a : b + 1] - self.starts[a]
        data = self.data[self.starts[a] : self.starts[b]]
        return pa.LargeStringArray.from_buffers(b - a, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data)))


def rows_of(table: pa.Table) -> Iterator[dict]:
    for batch in table.to_batches():
        for i in range(batch.num_rows):
            yield {c: batch.column(c)[i].as_py() for c in batch.schema.names}


def batch(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    """A batch from rows; schema: names with long, int or binary."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64(), "string": pa.string()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[k]) for i, (_, k) in enumerate(fields)], names=[n for n, _ in fields])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters them."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(names: pa.Array, salt: int = 0) -> np.ndarray:
    """64-bit hashes of distinct words."""
    import xxhash

    return np.fromiter((xxhash.xxh3_64_intdigest(x, salt) for x in names.cast(pa.large_binary()).to_pylist()), np.uint64, len(names))


crc = zlib.crc32


def pack_planes(values: np.ndarray) -> bytes:
    """Compressed bytes of unsigned numbers, first bytes first."""
    size = values.dtype.itemsize
    return pack(np.ascontiguousarray(values).view(np.uint8).reshape(-1, size).T)


def unpack_planes(blob: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(unpack(blob, np.uint8).reshape(size, -1).T).view(dtype).reshape(-1)


def pack_numbers(values: np.ndarray) -> bytes:
    """Compressed bytes of numbers from 0, each in as few bytes as the greatest needs."""
    most = int(values.max()) if len(values) else 0
    size = next(x for x in (1, 2, 4, 8) if most < 1 << (8 * x))
    return bytes([size]) + pack_planes(values.astype(f"u{size}"))


def unpack_numbers(blob: bytes) -> np.ndarray:
    return unpack_planes(blob[1:], f"u{blob[0]}").astype(np.int64)


def pack_sorted(values: np.ndarray) -> bytes:
    """Compressed bytes of rising unsigned numbers."""
    return pack_planes(np.diff(values, prepend=values.dtype.type(0)))


def unpack_sorted(blob: bytes, dtype) -> np.ndarray:
    return np.cumsum(unpack_planes(blob, dtype), dtype=dtype)
