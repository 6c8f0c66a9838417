"""Shared pieces of the training-data operators: vectorised word hashing over Arrow buffers,
byte-bounded slices of Arrow batches, delta-coded blobs and tables in the cluster's shared folder."""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

# Arrow's own pool keeps what it has freed, in every Python worker of an executor
pa.set_memory_pool(pa.system_memory_pool())

#: Bytes of text that the vectorised code looks at in one step; bounds the memory of a Python worker.
SLICE_BYTES = 1 << 20

#: ASCII white space as the word pattern ``[^\x20\x09-\x0D]+`` has it.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True

#: What parts words of letters and digits; bytes above 127 count as letters.
BREAK = np.ones(256, bool)
BREAK[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False

_RNG = np.random.default_rng(20240117)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15 & ~7 | 5)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a temporary one where it is unset, as in tests."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.conf.get("quern.local.checkpoint.dir", None)
        if not d:
            if not re.match(r"local($|\[)", spark.sparkContext.master):
                raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
            d = "file://" + tempfile.mkdtemp(prefix="quern-")
            spark.conf.set("quern.local.checkpoint.dir", d)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(d)
    return d.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back; cuts the lineage and outlives executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quern-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Delete tables that materialise has written, once nothing will read them again."""
    for t in tables:
        spark = t.sparkSession
        for folder in {f.rpartition("/")[0] for f in t.inputFiles()}:
            if "/quern-" in folder:
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of texts of ``rows`` rows at most: long texts would make larger ones crowd workers and executors."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def text_buffers(col) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n + 1 offsets of a string column, nulls being empty."""
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks) if col.num_chunks != 1 else col.chunk(0)
    if col.null_count:
        col = col.fill_null("")
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(batch, column: str = "text", limit: int = SLICE_BYTES):
    """Runs of rows of an Arrow batch or table with at most ``limit`` bytes of text (one row at least)."""
    n = batch.num_rows
    if not n:
        return
    _, off = text_buffers(batch.column(column))
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def word_spans(data: np.ndarray, off: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and for each document the index of its first word (n + 1 entries)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    inside = ~space[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, off)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


#: So many powers of the base, and of its inverse, are kept: enough for a slice of bounded size.
_MOST_POWERS = 1 << 22


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (int(_BASE), pow(int(_BASE), -1, 1 << 64)):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte strings data[start:end], which must not be empty nor overlap."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lens = ends - starts
    if len(data) < _MOST_POWERS:
        # sums up to each byte, of which a span is the difference, shifted back by the inverse power of its start
        power, inverse = _powers(1 << max(20, len(data).bit_length()))
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * power[: len(data)], out=total[1:])
        return mix((total[ends] - total[starts]) * inverse[starts] + lens.astype(np.uint64))
    at = np.zeros(len(starts), np.int64)
    np.cumsum(lens[:-1], out=at[1:])
    inner = np.arange(int(lens.sum()), dtype=np.int64) - np.repeat(at, lens)
    power = np.full(int(lens.max()), _BASE, np.uint64)
    power[0] = 1
    power = np.multiply.accumulate(power)
    value = _BYTE[data[inner + np.repeat(starts, lens)]] * power[inner]
    return mix(np.add.reduceat(value, at) + lens.astype(np.uint64))


def letter_words(col) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of letters and digits of a string column, and where each text's begin."""
    data, off = text_buffers(pc.utf8_lower(col))
    starts, ends, first = word_spans(data, off, BREAK)
    return span_hashes(data, starts, ends), first


def rolling(h: np.ndarray, width: int, base: int) -> np.ndarray:
    """Hashes of all windows of ``width`` consecutive hashes."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    b = np.uint64(base | 1)
    for i in range(width):
        out *= b
        out += h[i : i + n]
    return mix(out)


def pack_sorted(a: np.ndarray) -> bytes:
    """Ascending uint64 values as 32-bit steps where these suffice."""
    if not len(a):
        return b""
    step = np.diff(a)
    if len(step) and int(step.max()) >> 32:
        return b"\1" + a.tobytes()
    return b"\0" + a[:1].tobytes() + step.astype(np.uint32).tobytes()


def unpack_sorted(b: bytes) -> np.ndarray:
    if not b:
        return np.zeros(0, np.uint64)
    if b[0] == 1:
        return np.frombuffer(b, np.uint64, offset=1)
    out = np.empty((len(b) - 9) // 4 + 1, np.uint64)
    out[0] = np.frombuffer(b, np.uint64, 1, 1)[0]
    out[1:] = np.frombuffer(b, np.uint32, offset=9)
    return np.cumsum(out, dtype=np.uint64)


#: Bytes of a slice of a summed array.
PIECE = 1 << 16


def pieces(a: np.ndarray) -> tuple[list[int], list[bytes]]:
    """An array as slices of PIECE bytes with their numbers."""
    step = PIECE // a.itemsize
    n = -(-len(a) // step)
    return list(range(n)), [a[i * step : (i + 1) * step].tobytes() for i in range(n)]


def summed(parts: DataFrame, size: int, kind: str) -> np.ndarray:
    """Sum of arrays of ``size`` numbers, given as the slices (piece, x) of all of them.

    The slices of one place meet in one task, which adds them as they come. So the driver gets one array of ``size``
    numbers, however many arrays and partitions there are.
    """
    step = PIECE // np.dtype(kind).itemsize
    wide = "<f8" if kind == "<f4" else "<i8"

    def met(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for i, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                part = np.frombuffer(x.as_buffer(), kind)
                total[i] = total[i] + part if i in total else part.astype(wide)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["piece", "x"])

    out = np.zeros(size, wide)
    n = max(1, min(-(-size // step), 32))
    for i, x in parts.select("piece", "x").repartition(n, "piece").mapInArrow(met, "piece int, x binary").toLocalIterator():
        out[i * step : (i + 1) * step] = np.frombuffer(x, wide)
    return out
