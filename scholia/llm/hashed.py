"""Hashed text features computed in batches inside tasks, shared by the trained operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


#: Rows handled at once, so that few texts are held twice.
ROWS = 128


def few(source: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most so many rows."""
    return (b.slice(at, rows) for b in source for at in range(0, b.num_rows, rows))


@lru_cache(maxsize=1)
def c_library_trim() -> Callable[[int], int] | None:
    """What gives the C library's free memory back to the system, where there is such a function."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):
        return None


def tidied(made: Iterator[pa.RecordBatch], done: Callable[[], None] | None = None) -> Iterator[pa.RecordBatch]:
    """What a task makes; at its end the worker, which stays for other tasks, gives back the memory that this one took."""
    try:
        yield from made
    finally:
        if done:
            done()
        pa.default_memory_pool().release_unused()
        if (trim := c_library_trim()) is not None:
            trim(0)


def mapped(df: DataFrame, of: str, made: dict[str, tuple[str, pa.DataType]], run: Callable[[list], dict[str, list]], done: Callable[[], None] | None = None) -> DataFrame:
    """df with the columns made by run from each batch of column of; done ends a task. Made columns replace those of the same name."""
    names = {m.lower() for m in made}
    place, width = df.columns.index(of), len(df.columns)
    kept = [i for i in range(width) if df.columns[i].lower() not in names]
    plain = df.toDF(*[f"c{i}" for i in range(width)])
    fields = [f"c{i} {plain.schema[i].dataType.simpleString()}" for i in kept] + [f"m{k} {sql}" for k, (sql, _) in enumerate(made.values())]
    order, kinds = list(made), [kind for _, kind in made.values()]

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few(source, ROWS):
            found = run(batch.column(place).to_pylist())
            columns = [batch.column(i) for i in kept] + [pa.array(found[n], kind) for n, kind in zip(order, kinds)]
            yield pa.RecordBatch.from_arrays(columns, [f"c{i}" for i in kept] + [f"m{k}" for k in range(len(order))])

    return plain.mapInArrow(lambda source: tidied(batches(source), done), ", ".join(fields)).toDF(*[df.columns[i] for i in kept], *order)


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """For each code point of the basic plane, whether it is a letter."""
    return np.array([chr(c).isalpha() for c in range(0x10000)])


def gram_buckets(text: str, bits: int) -> np.ndarray:
    """Hashed grams of one to three characters of a whole text: letters in lower case, one blank for anything else.

    A text without letters has none.
    """
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    low = codes < 0x10000
    alpha = letters()[np.where(low, codes, 0)]
    if not low.all():
        alpha |= np.fromiter((not b and chr(c).isalpha() for c, b in zip(codes.tolist(), low.tolist())), bool, len(codes))
    if not alpha.any():
        return np.empty(0, np.int64)
    codes = np.where(alpha, codes, 32).astype(np.uint64)
    edge = alpha | np.concatenate(([True], alpha[:-1]))
    codes = np.concatenate(([32], codes[edge], [32])).astype(np.uint64)
    keys = [codes * np.uint64(0x9E3779B97F4A7C15)]
    keys.append((codes[:-1] << np.uint64(21) | codes[1:]) * np.uint64(0xC2B2AE3D27D4EB4F))
    if len(codes) > 2:
        keys.append((codes[:-2] << np.uint64(42) | codes[1:-1] << np.uint64(21) | codes[2:]) * np.uint64(0x9FB21C651E98DF25))
    return (np.concatenate(keys) >> np.uint64(64 - bits)).astype(np.int64)
