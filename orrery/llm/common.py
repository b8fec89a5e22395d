"""Shared parts of the text operators: bounded slices of Arrow batches and array-at-a-time text parsing.

All parsing works on the UTF-8 bytes of many documents at once (one byte buffer and its document
offsets), so that the cost per byte is a few array operations and memory is bounded by the slice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U = np.uint64
#: Bytes of text that one slice holds; a longer document makes a slice of its own.
SLICE_BYTES = 1 << 20
#: Rows that Spark hands over at a time in a tuned() session: its default of 10,000 whole texts takes much memory on both sides.
BATCH_ROWS = 1024
SLICE_ROWS = 4096

_R = 0x9E3779B97F4A7C15 | 1  # odd, so it has an inverse modulo 2**64
_R_INV = pow(_R, -1, 1 << 64)


def _table(seed: int, n: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(1, 2**64 - 1, n, dtype=np.uint64, endpoint=True) | U(1)


BYTE_VALUES = (_table(11, 256), _table(12, 256))

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes of the words that decontamination compares: digits, a-z, and all of any non-ASCII character.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit values."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U(29))
    x = x * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(32))


@dataclass
class Powers:
    """Powers of the hash base and of its inverse, grown on demand and kept for the life of a worker."""

    up: np.ndarray
    down: np.ndarray

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, SLICE_BYTES + 2)
            for name, base in (("up", _R), ("down", _R_INV)):
                out = np.empty(size, U)
                out[0] = 1
                done = 1
                step = base
                while done < size:  # out[done:2*done] = out[:done] * base**done
                    m = min(done, size - done)
                    out[done : done + m] = out[:m] * U(step)
                    done += m
                    step = step * step % (1 << 64)
                setattr(self, name, out)
        return self.up[:n], self.down[:n]


POWERS = Powers(np.empty(0, U), np.empty(0, U))


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Prefix sums from which span_hash() reads the hash of any span of values (uint64)."""
    up, _ = POWERS.get(len(values) + 1)
    out = np.zeros(len(values) + 1, U)
    np.cumsum(values * up[:-1] if len(values) else values, out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of spans [start, end), equal for equal contents wherever they stand."""
    _, down = POWERS.get(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start])


@dataclass
class Slice:
    """Some documents: ids as an Arrow array, bytes of all texts, and where each text begins and ends."""

    batch: pa.RecordBatch
    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def slices(batches: Iterable[pa.RecordBatch], text: int, max_bytes: int = SLICE_BYTES, max_rows: int = SLICE_ROWS) -> Iterator[Slice]:
    """Cuts batches into slices of bounded size. A null text is an empty one."""
    for batch in batches:
        data, at = _bytes_of(batch.column(text))
        first, n = 0, batch.num_rows
        while first < n:
            last = int(np.searchsorted(at, at[first] + max_bytes, "right")) - 1
            last = min(max(last, first + 1), first + max_rows, n)
            yield Slice(batch.slice(first, last - first), data[at[first] : at[last]], at[first : last + 1] - at[first])
            first = last


def words_of(data: np.ndarray, offsets: np.ndarray, word_byte: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, bounds): the words of all documents in order; document i has words bounds[i]:bounds[i+1]."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = word_byte[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | cut))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | cut))
    return starts, ends, np.searchsorted(starts, offsets)


def char_count(data: np.ndarray) -> np.ndarray:
    """Running count of code points: its difference over a span is the span's number of characters."""
    out = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out


def window_hash(values: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k values; windows that cross documents are for the caller to leave out."""
    n = max(0, len(values) - k + 1)
    out = np.zeros(n, U)
    for j in range(k):
        out = out * U(_R) + values[j : j + n]
    return mix(out)


def sliding_min(values: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each run of w values."""
    out, have = values, 1
    while have < w:
        step = min(have, w - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def anchors(grams: np.ndarray, w: int, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, number, anchor) of the runs of windows that share an anchor.

    A window starts at each place where valid is true and holds w consecutive grams; its anchor is
    the place of the smallest of them (by the upper 32 bits, the leftmost of equal ones). That depends
    on the window's content alone, so windows of equal content have equal grams at their anchors.
    """
    if not len(valid) or not valid.any():
        return (np.empty(0, np.int64),) * 3
    packed = (grams & U(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    at = np.flatnonzero(valid)
    anchor = (sliding_min(packed, w)[at] & U(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, (np.diff(anchor) != 0) | (np.diff(at) != 1)])
    return at[first], np.diff(np.r_[first, len(at)]), anchor[first]


def lists_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, bounds) of a list column; a null list is an empty one."""
    if column.null_count:
        column = column.fill_null([])
    bounds = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False)[bounds[0] : bounds[-1]], bounds - bounds[0]


def tuned(spark: SparkSession) -> SparkSession:
    """The session, handing BATCH_ROWS rows to Python at a time where nothing else is set. For programs: operators change no setting."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(BATCH_ROWS))
    return spark


def map_slices(df: DataFrame, schema: str, work: Callable[[Slice], dict | pa.RecordBatch | None], text: int = 1, max_bytes: int = SLICE_BYTES) -> DataFrame:
    """Runs work on each slice; work returns the columns of its rows, as arrays in the schema's order."""
    names = [x.name for x in df.sparkSession.createDataFrame([], schema).schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text, max_bytes):
            out = work(part)
            if out is not None:
                yield pa.RecordBatch.from_arrays([x if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x) for x in out.values()], names)

    return df.mapInArrow(run, schema)


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which all executors reach; set here only where it is unset and all runs in one process (tests)."""
    import tempfile
    import uuid

    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark._jsc.sc().isLocal():
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        top = tempfile.mkdtemp(prefix="orrery-")
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: What written() has made and nothing has removed, in the order of making.
_KEPT: list[DataFrame] = []
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows, kept as a table in the shared folder: the plan before it is cut, and lost executors lose nothing.

    The shuffle files of the job that writes them are removed with its end; the session's own setting holds again after it.
    """
    spark = df.sparkSession
    path, before = shared_dir(spark, name), spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.kept_at = path
    _KEPT.append(out)
    return out


def discard(*tables: DataFrame) -> None:
    """Removes tables that written() made and that nothing reads any more: what was made of them is written itself."""
    for df in tables:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.kept_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
        _KEPT[:] = [x for x in _KEPT if x.kept_at != df.kept_at]


@contextmanager
def scratch(*keep: str) -> Iterator[None]:
    """Removes on leaving what written() made inside, but for tables of the names to keep.

    Operators return frames that are not run yet and read their last tables; a caller that writes or collects a result inside leaves nothing behind.
    """
    before = {x.kept_at for x in _KEPT}
    try:
        yield
    finally:
        discard(*(x for x in list(_KEPT) if x.kept_at not in before and x.kept_at.rsplit("/", 1)[-1].rsplit("-", 1)[0] not in keep))


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    """A table of the folder, for a query: the session is tuned() for it."""
    return tuned(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def doc_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns that an operator reads, whatever else the table holds."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
