"""Whole texts as numpy arrays: slicing of Arrow batches, words, hashes, ids."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Bytes of text that one numpy step holds; a longer single text goes alone.
SLICE_BYTES = 2 << 20
_BATCH_BYTES, _BATCH_ROWS = 2 << 20, 2000
#: What this worker keeps for later tasks, and the names that its present task asked for.
_kept: dict = {}
_asked: set = set()


def bounded_batches(df: DataFrame) -> None:
    """Arrow batches between the JVM and Python stay small, however long the texts."""
    spark = df.sparkSession
    for key, most in (("maxBytesPerBatch", _BATCH_BYTES), ("maxRecordsPerBatch", _BATCH_ROWS)):
        key = f"spark.sql.execution.arrow.{key}"
        if not 0 < int(str(spark.conf.get(key)).rstrip("bB")) <= most:
            spark.conf.set(key, str(most))


def give_back() -> None:
    """Hand free memory back to the system: workers are reused, and an executor's share is for all of them."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def handing_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's function that hands free memory back when it is through its rows."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return whole


def kept(name, make: Callable[[], object]):
    """What ``make`` gives, from an earlier task of this worker if that one made it and every task since asked for it when it began."""
    _asked.add(name)
    if name not in _kept:
        _kept[name] = make()
    return _kept[name]


def begin(make: Callable[[], Callable]) -> Callable:
    """``make()`` at the begin of a task; what earlier tasks kept and this one doesn't ask for goes."""
    _asked.clear()
    step = make()
    if set(_kept) - _asked:
        for name in set(_kept) - _asked:
            del _kept[name]
        give_back()
    return step


def text_bytes(texts: pa.Array) -> np.ndarray:
    """UTF-8 length of each text, null as 0."""
    return pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES, size: Callable[[pa.Array], np.ndarray] = text_bytes) -> Iterator[pa.RecordBatch]:
    """Row ranges of a batch whose texts have about ``limit`` bytes together, by ``size``."""
    if batch.num_rows == 0:
        return
    group = np.cumsum(size(batch.column(text))) // limit
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)


def map_texts(
    df: DataFrame,
    text: str,
    make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]],
    schema: T.StructType,
    limit: int = SLICE_BYTES,
) -> DataFrame:
    """``make()`` once a task, then its function over each slice of rows."""
    bounded_batches(df)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = None
        for batch in batches:
            for part in slices(batch, text, limit):
                step = step or begin(make)
                yield step(part)
        del step
        give_back()

    return df.mapInArrow(run, schema)


def filled(texts: pa.Array) -> pa.Array:
    """Null texts as empty ones."""
    return pc.fill_null(texts.cast(pa.string()), "")


def words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words ``[^\\x20\\x09-\\x0D]+`` in order, and where each text's begin and end."""
    split = pc.ascii_split_whitespace(texts)
    flat, offsets = split.flatten(), split.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    size = pc.binary_length(flat).to_numpy(zero_copy_only=False)
    if size.size and (size == 0).any():
        keep = size > 0
        before = np.concatenate([[0], np.cumsum(keep)])
        flat, offsets = flat.filter(pa.array(keep)), before[offsets]
    return flat, offsets


def encode(flat: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Distinct words and the position of each word among them."""
    coded = flat.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def hashes(values: pa.Array, seed: int) -> np.ndarray:
    """XXH64 of each value's UTF-8 bytes."""
    one = xxhash.xxh64_intdigest
    data = memoryview(values.buffers()[2] or b"")
    at = np.frombuffer(values.buffers()[1], np.int32, len(values) + 1, values.offset * 4).tolist() if len(values) else [0]
    return np.fromiter((one(data[a:b], seed) for a, b in zip(at, at[1:])), np.uint64, len(values))


def owner(offsets: np.ndarray) -> np.ndarray:
    """The text's number for each word."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of the values of each text; 0 where it has none."""
    out = np.zeros(len(offsets) - 1, values.dtype)
    full = np.flatnonzero(np.diff(offsets))
    if len(full):
        out[full] = np.add.reduceat(values, offsets[full])
    return out
