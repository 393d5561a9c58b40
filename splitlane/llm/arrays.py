"""Numpy helpers that run inside Spark tasks: token tables and rolling hashes.

A batch of texts is one byte array plus offsets. Words are maximal runs of bytes
other than space and U+0009 to U+000D; in UTF-8 those bytes occur nowhere else,
so cutting bytes is the same as cutting characters. All hashes are 64 bits wide.
"""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

BYTE_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
WORD_BASE = np.uint64(0xD1B54A32D192ED03 | 1)
# Multipliers of the splitmix64 finaliser.
MIX_1 = np.uint64(0xBF58476D1CE4E5B9)
MIX_2 = np.uint64(0x94D049BB133111EB)

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def remembered(key: tuple, make: Callable[[], object]) -> object:
    """What ``make`` gives, made once per process.

    Functions reach a worker by value, each with modules of its own, so a module's
    variable would be made again, and kept until the garbage is collected, for every task.
    """
    kept = sys.modules.setdefault("splitlane_llm_kept", types.ModuleType("splitlane_llm_kept")).__dict__
    if key not in kept:
        kept[key] = make()
    return kept[key]


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values, one to one."""
    x = x ^ (x >> np.uint64(30))
    x *= MIX_1
    x ^= x >> np.uint64(27)
    x *= MIX_2
    x ^= x >> np.uint64(31)
    return x


def powers(base: np.uint64, n: int) -> np.ndarray:
    """``base`` to the powers 0 to n - 1, modulo 2**64."""
    # Lengths are rounded up to powers of two, so that few tables are made.
    length = 1 << max(n - 1, 1 << 19).bit_length()
    return remembered(("powers", int(base), length), lambda: _power_table(base, length))[:n]


def _power_table(base: np.uint64, length: int) -> np.ndarray:
    factors = np.full(length, base, np.uint64)
    factors[0] = 1
    return np.cumprod(factors)


def _inverse(base: np.uint64) -> np.uint64:
    return np.uint64(pow(int(base), -1, 1 << 64))


def span_hashes(values: np.ndarray, base: np.uint64, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hash of values[starts:ends], the same wherever the span lies."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(base, len(values)), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * powers(_inverse(base), len(values) + 1)[starts])


def window_hashes(values: np.ndarray, base: np.uint64, width: int) -> np.ndarray:
    """Rolling (Rabin-Karp) hash of every ``width`` consecutive values."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(base, len(values)), out=sums[1:])
    return mix((sums[width:] - sums[:-width]) * powers(_inverse(base), n))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and where each text begins; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(batches, column: str, most: int = 512 << 10) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each holds about ``most`` bytes of text, one text at least."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, off = text_buffers(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def word_table(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where words start and end, and the number of the first word of each text (one more at the end)."""
    solid = ~_SPACE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[off] = True
    begins, stops = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1] | cut[1:-1]
    stops[:-1] &= ~solid[1:] | cut[1:-1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(stops) + 1, np.searchsorted(starts, off)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    # One is added so that leading zero bytes count.
    return span_hashes(data.astype(np.uint64) + np.uint64(1), BYTE_BASE, starts, ends)


def grouped_ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of each range, one range after the other."""
    total = int(lengths.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts - before, lengths)
