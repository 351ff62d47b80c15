"""Helpers shared by the operators: scratch tables, size-checked broadcast, Arrow text buffers, word hashes.

Functions that run in tasks are sent by value (see the end of each module), so workers need no
installed package.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwork.session import materialize, small

__all__ = ["materialize", "small", "ascii_lower", "row_key", "text_slices", "column_bytes", "word_hashes", "mix", "crc32_fold"]

SLICE_BYTES = 2 << 20
MOST_KEYS = 1_000_000       # so many keys (some 50 bytes each) may be broadcast; more are joined by a shuffle
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text):
    """Lower-case A-Z and nothing else. Pure ASCII takes the fast built-in path."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def row_key(id_col, text):
    """A key of (id, text): rows that agree in both are repeats of one row. The id's length stands before
    it and null has a form of its own, so that no two different pairs are written alike; a null text counts
    as empty."""
    named = id_col.cast("string")
    return F.md5(F.concat(F.coalesce(F.concat(F.length(named).cast("string"), F.lit(":"), named), F.lit("-")), F.lit("|"),
                          F.coalesce(text, F.lit(""))))


def crc32_fold(id_col, folds: int):
    """crc32 of the id as text, modulo `folds`; a null id counts as the text ''."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % F.lit(folds)


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    if len(offsets) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0]:offsets[-1]], offsets - offsets[0]


def text_slices(batch: pa.RecordBatch, name: str, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a batch into runs of rows of about `limit` bytes of text (a longer text is a run of its
    own): (first row, row after the last, bytes, offsets)."""
    data, offsets = column_bytes(batch.column(batch.schema.get_field_index(name)))
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), rows)
        yield first, last, data[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first]
        first = last


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_powers: dict[str, np.ndarray] = {}


def _power(kind: str, n: int) -> np.ndarray:
    """Powers of an odd base modulo 2**64 and of its inverse, grown on demand."""
    have = _powers.get(kind)
    if have is None or len(have) < n:
        base = _BASE if kind == "up" else pow(_BASE, -1, 1 << 64)
        steps = np.full(max(n, SLICE_BYTES + 1), base, np.uint64)
        steps[0] = 1
        have = _powers[kind] = np.multiply.accumulate(steps)
    return have


def word_hashes(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray, values: np.ndarray | None = None):
    """Hash every word of a run of texts without a Python loop.

    `is_word` says for each byte whether it belongs to words. Returns the start and end byte of each
    word, its 64-bit hash (a polynomial over byte values, from prefix sums) and, per text, the number
    of its first word (one entry more than texts).
    """
    n = len(data)
    inside = is_word[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    begins = offsets[:-1][(offsets[:-1] < offsets[1:])]
    first[begins] = inside[begins]
    ends = offsets[1:][(offsets[:-1] < offsets[1:])] - 1
    last[ends] = inside[ends]
    start, stop = np.flatnonzero(first), np.flatnonzero(last) + 1
    table = _BYTE_VALUES if values is None else values
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(table[data] * _power("up", n)[:n], out=sums[1:])
    hashes = mix((sums[stop] - sums[start]) * _power("down", n)[start] + (stop - start).astype(np.uint64))
    return start, stop, hashes, np.searchsorted(start, offsets)


def send_by_value(module) -> None:
    cloudpickle.register_pickle_by_value(module)


def count_at_most(df: DataFrame, rows: int) -> bool:
    return df.limit(rows + 1).count() <= rows


send_by_value(sys.modules[__name__])
