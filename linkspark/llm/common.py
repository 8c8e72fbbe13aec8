"""Helpers shared by the operators: table access, shared storage, word splitting.

Words are runs of bytes other than space and 0x09-0x0D.  All of these bytes are
below 0x80, so splitting UTF-8 bytes and splitting code points agree.
"""

from __future__ import annotations

import ctypes
import inspect
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one step inside a Python worker handles at once (a longer text is one step).
STEP_BYTES = 3 << 20
#: Bytes of a group after which a Python worker gives free memory back.
GROUP_BYTES = 1 << 20


_shipped: set[str] = set()


def _ship(spark: SparkSession) -> None:
    """Give the executors this package, once for each application: they need not have it installed."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    import pathlib
    import tempfile
    import zipfile

    top = pathlib.Path(__file__).resolve().parents[1]
    target = pathlib.Path(tempfile.mkdtemp()) / f"{top.name}.zip"
    with zipfile.ZipFile(target, "w") as out:
        for path in sorted(top.rglob("*.py")):
            out.write(path, str(path.relative_to(top.parent)))
    context.addPyFile(str(target))
    _shipped.add(context.applicationId)


def tune(spark: SparkSession) -> None:
    """Ready a session: executors get the package, and batches for Python workers are of few rows, as texts are long."""
    _ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, read by Spark so that any store works."""
    tune(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def give_back() -> None:
    """Return memory that is free in this process to the system, as far as its allocators can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the GNU C library has it
    if trim:
        trim(0)


def lean(run: Callable) -> Callable:
    """`run`, for mapInArrow or applyInArrow, giving free memory back when it is done.

    Python workers live on from task to task, and allocators keep what a task freed: without
    this each worker holds the most that any stage before needed, besides the JVM's memory.
    Groups of less than GROUP_BYTES aren't worth the call.
    """
    if inspect.isgeneratorfunction(run):

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            try:
                yield from run(batches)
            finally:
                give_back()

        return task

    def group(*tables: pa.Table) -> pa.Table:
        try:
            return run(*tables)
        finally:
            if sum(x.nbytes for x in tables) >= GROUP_BYTES:
                give_back()

    if len(inspect.signature(run).parameters) == 1:
        return lambda table: group(table)
    return lambda left, right: group(left, right)


def give_back_heap(spark: SparkSession) -> None:
    """Return memory that is free in the executors' JVMs to the system.

    A JVM keeps the heap that an earlier stage needed, free or not, besides the memory of
    its Python workers; a full collection shrinks it.  One short task for each core, so that
    idle executors all get some; collections asked for at the same time are done once.
    """
    cores = spark.sparkContext.defaultParallelism
    spark.range(0, cores, 1, cores).select(F.java_method(F.lit("java.lang.System"), F.lit("gc"))).collect()


def crc_mod(column: str, mod: int) -> Column:
    """crc32 of the column as text, modulo mod (null stays null)."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(mod)


def sampled(rows: DataFrame, n: int, id_column: str = "id", total: int | None = None) -> DataFrame:
    """The n rows of least hash of their id (all, if there are fewer).

    Rows far above the n-th hash are filtered out first, so few rows are ever sorted
    or sent, however many tasks there are.
    """
    total = rows.count() if total is None else total
    ways = 1 << 40
    place = F.pmod(F.xxhash64(id_column), F.lit(ways))
    share = min(1.0, (2 * n + 100) / max(total, 1))
    return rows.filter(place <= int(share * ways)).orderBy(place, id_column).limit(n)


def steps(batches: Iterator[pa.RecordBatch], column: str, limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Regroup batches so that each holds about `limit` bytes of `column`."""
    held: list[pa.RecordBatch] = []
    size = 0

    def joined() -> pa.RecordBatch:
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0] if len(held) > 1 else held[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64)
        ends = np.cumsum(lengths)
        begin = 0
        base = 0
        while begin < batch.num_rows:
            room = max(limit - size, 1)
            stop = max(int(np.searchsorted(ends, base + room, "right")), begin + (not held))
            if stop > begin:
                held.append(batch.slice(begin, stop - begin))
                size += int(ends[stop - 1] - base)
                base, begin = int(ends[stop - 1]), stop
            if begin < batch.num_rows:
                yield joined()
                held, size = [], 0
    if held:
        yield joined()


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(starts of each row's words and the end, word ids, distinct words)."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
    coded = lists.flatten().dictionary_encode()
    ids = np.asarray(coded.indices)
    starts = np.asarray(lists.offsets).astype(np.int64)
    starts = starts - starts[0]
    empty = pc.index(coded.dictionary, pa.scalar("", coded.dictionary.type)).as_py()
    if empty >= 0:
        full = ids != empty
        starts = np.concatenate([[0], np.cumsum(full)])[starts]
        ids = ids[full]
    return starts, ids, coded.dictionary


def row_sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sum of values[starts[i]:starts[i+1]] for each i."""
    ends = np.concatenate([[0], np.cumsum(values, dtype=np.float64 if values.dtype.kind == "f" else np.int64)])
    return ends[starts[1:]] - ends[starts[:-1]]


def gather(lists_starts: np.ndarray, values: np.ndarray, picked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenate the lists picked by index; returns (values, starts of each picked list and the end)."""
    lengths = (lists_starts[1:] - lists_starts[:-1])[picked]
    starts = np.concatenate([[0], np.cumsum(lengths)])
    where = np.repeat(lists_starts[picked] - starts[:-1], lengths)
    where += np.arange(starts[-1])
    return values[where], starts


def compact(lists: list[list[int]], dtype=np.int32) -> tuple[np.ndarray, np.ndarray]:
    """(starts and the end, values) of a list of lists."""
    lengths = np.fromiter(map(len, lists), np.int64, len(lists))
    starts = np.concatenate([[0], np.cumsum(lengths)])
    from itertools import chain

    return starts, np.fromiter(chain.from_iterable(lists), dtype, int(starts[-1]))


def bytes_of(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(starts and the end, bytes) of a string or binary array without nulls."""
    strings = strings.cast(pa.large_binary())
    if not len(strings):
        return np.zeros(1, np.int64), np.empty(0, np.uint8)
    offsets = np.frombuffer(strings.buffers()[1], np.int64)[strings.offset : strings.offset + len(strings) + 1]
    data = np.frombuffer(strings.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if strings.buffers()[2] is not None else np.empty(0, np.uint8)
    return offsets - offsets[0], data
