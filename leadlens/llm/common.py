"""Helpers shared by the training-data operators.

``written`` cuts lineage through a Parquet table in the shared folder (an
executor lost later re-reads files instead of recomputing).  The byte helpers
turn an Arrow text column into one flat byte buffer so that a whole batch is
hashed by a handful of NumPy passes, whatever the length of its texts.
"""

from __future__ import annotations

import contextlib
import ctypes
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from leadlens.session import scratch_path

# Bytes hashed in one NumPy pass; bounds the temporaries of a batch of any size.
CHUNK_BYTES = 1 << 19
_BASE = 0x9E3779B97F4A7C15
_U = np.uint64

SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: dict[str, np.ndarray] = {}


def table_path(spark: SparkSession, name: str) -> str:
    return scratch_path(spark, "llm", f"{name}-{uuid.uuid4().hex[:10]}")


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written once to the shared folder and read back."""
    spark = df.sparkSession
    path = table_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package's sources, once per application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="leadlens-src-"), "leadlens.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("leadlens", os.path.relpath(full, root)))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def release() -> None:
    """Give freed memory back to the system: a worker lives on for the tasks of later stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):       # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def map_batches(df: DataFrame, function: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` with this package importable on every executor."""
    ship(df.sparkSession)

    def run(batches):
        yield from function(batches)
        release()

    return df.mapInArrow(run, schema)


def byte_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts one after the other, offsets); a null is an empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col.cast(pa.large_binary()), b"")
    n = len(col)
    _, off, data = col.buffers()
    if n == 0 or off is None:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(off, np.int64)[col.offset:col.offset + n + 1]
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat[offsets[0]:offsets[-1]], offsets - offsets[0]


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (splitmix64)."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of the hash base and of its inverse modulo 2**64."""
    have = _powers.get("pow")
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + 1)
        for name, base in (("pow", _BASE), ("inv", pow(_BASE, -1, 1 << 64))):
            a = np.full(size, base, dtype=_U)
            a[0] = 1
            _powers[name] = np.multiply.accumulate(a)
    return _powers["pow"][:n], _powers["inv"][:n]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Polynomial prefix sums of the bytes: entry i covers data[:i]."""
    out = np.zeros(len(data) + 1, dtype=_U)
    p, _ = powers(len(data))
    np.cumsum((data.astype(_U) + _U(1)) * p, out=out[1:])
    return out


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span [start, end) of the bytes behind ``sums``."""
    _, inv = powers(len(sums))
    return mix((sums[ends] - sums[starts]) * inv[starts] + (ends - starts).astype(_U) * _U(0xD6E8FEB86659FD93))


def _cut(data: np.ndarray, offsets: np.ndarray, lo: int) -> int:
    """End of the chunk that begins at lo: behind a separator or at a text's start."""
    n, width = len(data), CHUNK_BYTES
    while lo + width < n:
        hi = lo + width
        seps = np.flatnonzero(SEPARATOR[data[lo:hi]])
        text = offsets[np.searchsorted(offsets, hi, side="right") - 1]
        at = max(lo + int(seps[-1]) + 1 if len(seps) else lo, int(text))
        if at > lo:
            return at
        width *= 2
    return n


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash) of every word ``[^\\x20\\x09-\\x0D]+``, in order, A-Z lower-cased."""
    starts, ends, hashes = [], [], []
    lo, n = 0, len(data)
    text_starts = offsets[:-1]
    while lo < n:
        hi = _cut(data, offsets, lo)
        part = data[lo:hi]
        word = ~SEPARATOR[part]
        first = np.zeros(hi - lo, dtype=bool)
        a, b = np.searchsorted(text_starts, [lo, hi])
        first[text_starts[a:b] - lo] = True
        first[0] = True
        begins = word.copy()
        begins[1:] &= ~word[:-1] | first[1:]
        finishes = word.copy()
        finishes[:-1] &= ~word[1:] | first[1:]
        s, e = np.flatnonzero(begins), np.flatnonzero(finishes) + 1
        hashes.append(span_hashes(prefix_sums(LOWER[part] if lower else part), s, e))
        starts.append(s + lo)
        ends.append(e + lo)
        lo = hi
    if not starts:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0, _U)
    return np.concatenate(starts), np.concatenate(ends), np.concatenate(hashes)


def owner(offsets: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """Index of the text that holds each byte position."""
    return np.searchsorted(offsets, positions, side="right") - 1


def shingles(doc: np.ndarray, hashes: np.ndarray, width: int, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """(doc, hash) of the distinct ``width``-word shingles of each text, sorted; a text of
    fewer words has its whole sequence as its only shingle."""
    count = np.bincount(doc, minlength=n_docs) if len(doc) else np.zeros(n_docs, np.int64)
    begin = np.concatenate([[0], np.cumsum(count)])
    odd = _U(0xA0761D6478BD642F)
    at, value = [], []
    if len(hashes) >= width:
        h = np.zeros(len(hashes) - width + 1, dtype=_U)
        for k in range(width):
            h = h * odd + hashes[k:len(hashes) - width + 1 + k]
        inside = doc[:len(h)] == doc[width - 1:]
        at.append(doc[:len(h)][inside])
        value.append(mix(h[inside]))
    for n in range(1, width):
        short = np.flatnonzero(count == n)
        if len(short):
            h = np.full(len(short), n, dtype=_U)
            for k in range(n):
                h = h * odd + hashes[begin[short] + k]
            at.append(short)
            value.append(mix(h))
    if not at:
        return np.zeros(0, np.int64), np.zeros(0, _U)
    d, v = np.concatenate(at), np.concatenate(value)
    order = np.lexsort((v, d))
    d, v = d[order], v[order]
    new = np.ones(len(d), dtype=bool)
    new[1:] = (d[1:] != d[:-1]) | (v[1:] != v[:-1])
    return d[new], v[new]


def list_column(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow list column from flat values and the length of each list."""
    offsets = np.zeros(len(counts) + 1, dtype=np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def slices(offsets: np.ndarray, limit: int):
    """Ranges [i, j) of texts that hold about ``limit`` bytes, at least one text each."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j
