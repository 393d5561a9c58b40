"""Periodic run detection: stretches of words that repeat with a short period.

A run is a maximal stretch of consecutive words whose smallest period q (words q
apart are equal) gives it a length of at least max(6, 4q). Runs are found per text,
inside the tasks that read it:

* periods up to ``SHORT`` by direct lag scans: word i against word i + q;
* longer periods by multi-scale minimizers. For the scale [lo, 2 lo) every window of
  ``lo`` hashes of ``lo``-word grams names its leftmost smallest gram. Inside a run of
  period q in the scale such a window and the one q words later are equal, so their
  minimizers are equal and q apart. Pairs of equal minimizers at a distance in the
  scale seed an extension with that lag; the extension decides, hashes only propose.
  Minimizers lying deep inside a run of a shorter period seed nothing: by Fine and
  Wilf a stretch of another period passing through them has a shorter period itself.

Every run is found (the window of its first words always seeds it); words are told
apart by 64-bit hashes of their bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from splitlane.llm import arrays as A

# Periods up to this are found by direct lag scans.
SHORT = 8
GRAM_BASE = np.uint64(0xC2B2AE3D27D4EB4F | 1)
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
_LONGS = T.ArrayType(T.LongType())
RESULT = T.StructType(
    [
        T.StructField("starts", _LONGS),
        T.StructField("lengths", _LONGS),
        T.StructField("periods", _LONGS),
        T.StructField("collapsed", T.StringType()),
    ]
)
LOW32 = np.uint64(0xFFFFFFFF)


def shortest(period: int) -> int:
    """The shortest length of a run of this period."""
    return max(6, 4 * period)


def _stretches(equal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the maximal runs of True."""
    steps = np.diff(np.concatenate(([0], equal.astype(np.int8), [0])))
    return np.flatnonzero(steps == 1), np.flatnonzero(steps == -1)


def _smallest_is(h: np.ndarray, start: int, length: int, period: int) -> bool:
    """Whether no divisor of ``period`` below it is a period of the stretch too."""
    part = h[start : start + length]
    for d in range(1, period // 2 + 1):
        if period % d == 0 and np.array_equal(part[:-d], part[d:]):
            return False
    return True


def _reach_right(h: np.ndarray, at: int, lag: int) -> int:
    """The end of the stretch with period ``lag`` that holds words ``at`` and ``at + lag``."""
    n, x, step = len(h), at, 64
    while x + lag < n:
        to = min(n - lag, x + step)
        differ = np.flatnonzero(h[x:to] != h[x + lag : to + lag])
        if differ.size:
            return int(x + differ[0] + lag)
        x, step = to, step * 2
    return n


def _reach_left(h: np.ndarray, at: int, lag: int) -> int:
    x, step = at, 64
    while x > 0:
        fro = max(0, x - step)
        differ = np.flatnonzero(h[fro:x] != h[fro + lag : x + lag])
        if differ.size:
            return int(fro + differ[-1] + 1)
        x, step = fro, step * 2
    return 0


def _leftmost_minima(keys: np.ndarray, width: int) -> np.ndarray:
    """The smallest key of every ``width`` consecutive keys (van Herk and Gil-Werman)."""
    n = len(keys)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = keys
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    last = n - width + 1
    return np.minimum(behind[:last], ahead[width - 1 : width - 1 + last])


def _seeds(h: np.ndarray, lo: int, hi: int, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Anchors and lags in [lo, hi) proposed by equal minimizers of the scale."""
    grams = A.window_hashes(h, GRAM_BASE, lo)
    if len(grams) < lo:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    where = np.arange(len(grams), dtype=np.uint64)
    keys = ((grams >> np.uint64(32)) << np.uint64(32)) | where
    chosen = np.unique(_leftmost_minima(keys, lo) & LOW32).astype(np.int64)
    # Deep inside a run of a shorter period no lag of this scale can give a run.
    chosen = chosen[reach[chosen] < chosen + hi + lo]
    if chosen.size < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    packed = np.sort(((grams[chosen] >> np.uint64(32)) << np.uint64(32)) | chosen.astype(np.uint64))
    first = np.searchsorted(packed, packed + np.uint64(lo))
    last = np.searchsorted(packed, packed + np.uint64(hi))
    partners = A.grouped_ranges(first, last - first)
    anchors = np.repeat(np.arange(len(packed)), last - first)
    at = (packed[anchors] & LOW32).astype(np.int64)
    return at, (packed[partners] & LOW32).astype(np.int64) - at


def find_runs(h: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of the word sequence ``h``, by start, then period."""
    n = len(h)
    found: set[tuple[int, int, int]] = set()
    for q in range(1, min(SHORT, n // 4) + 1):
        starts, ends = _stretches(h[:-q] == h[q:])
        long = ends - starts + q >= shortest(q)
        for s, e in zip(starts[long].tolist(), ends[long].tolist()):
            if _smallest_is(h, s, e - s + q, q):
                found.add((s, e - s + q, q))
    lo = SHORT + 1
    while 4 * lo <= n:
        hi = 2 * lo
        reach = np.full(n, -1, np.int64)
        for s, length, _ in found:
            reach[s] = max(reach[s], s + length)
        reach = np.maximum.accumulate(reach)
        at, lags = _seeds(h, lo, hi, reach)
        fits = 4 * lags <= n
        pairs = np.unique(lags[fits] * (n + 1) + at[fits])
        done, lag_of = -1, -1
        for lag, m in zip((pairs // (n + 1)).tolist(), (pairs % (n + 1)).tolist()):
            if lag != lag_of:
                done, lag_of = -1, lag
            # Anchors before ``done`` lie in the stretch of this lag already measured.
            if m < done or h[m] != h[m + lag]:
                continue
            s, e = _reach_left(h, m, lag), _reach_right(h, m, lag)
            done = e - lag
            if e - s >= shortest(lag) and _smallest_is(h, s, e - s, lag):
                found.add((s, e - s, lag))
        lo = hi
    return sorted(found)


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words left once every run keeps only its first period."""
    if not runs:
        return b" ".join(words)
    steps = np.zeros(len(words) + 1, np.int32)
    for start, length, period in runs:
        steps[start + period] += 1
        steps[start + length] -= 1
    gone = np.cumsum(steps[:-1]) > 0
    return b" ".join(w for w, g in zip(words, gone.tolist()) if not g)


# Bytes of text hashed at once: the hash tables of a slice are eight times its size.
SLICE_BYTES = 512 << 10


def _slices(off: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of texts holding about SLICE_BYTES each, one text at least."""
    out, at, n = [], 0, len(off) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + SLICE_BYTES, "right")) - 1)
        out.append((at, to))
        at = to
    return out


@F.arrow_udf(RESULT)
def _runs_of(text: pa.Array) -> pa.Array:
    data, off = A.text_buffers(text)
    counts, s_out, l_out, p_out, collapsed = [0], [], [], [], []
    for lo, hi in _slices(off):
        piece, cuts = data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        raw = piece.tobytes()
        starts, ends, first = A.word_table(piece, cuts)
        hashes = A.word_hashes(piece, starts, ends)
        for i in range(hi - lo):
            runs = find_runs(hashes[first[i] : first[i + 1]])
            for s, length, q in runs:
                s_out.append(s)
                l_out.append(length)
                p_out.append(q)
            counts.append(counts[-1] + len(runs))
            collapsed.append(collapse(raw[cuts[i] : cuts[i + 1]].split(), runs).decode("utf-8", "replace"))
    offsets = pa.array(counts, pa.int32())

    def listed(values: list[int]) -> pa.Array:
        return pa.ListArray.from_arrays(offsets, pa.array(values, pa.int64()))

    return pa.StructArray.from_arrays(
        [listed(s_out), listed(l_out), listed(p_out), pa.array(collapsed, pa.string())],
        ["starts", "lengths", "periods", "collapsed"],
    )


def periodic_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``runs`` (every run of the words of ``text``) and ``collapsed``.

    Words are maximal runs of characters other than space and U+0009 to U+000D,
    numbered from 0. ``runs`` holds (start, length, period) of every run by start, then
    period; ``collapsed`` is the words left once each run keeps only its first period
    words, joined by one space. Null and empty texts have no words: no runs and an
    empty ``collapsed``. Very long texts are worked on whole, one text in a task at a
    time. Repeated rows get equal results; no row is dropped. An empty table gives an
    empty table. Columns of ``docs`` named ``runs`` or ``collapsed`` are replaced.
    """
    found = "__periodic_runs"
    plain = docs.drop("runs", "collapsed")
    made = plain.withColumn(found, _runs_of(F.coalesce(F.col(text), F.lit(""))))
    runs = F.arrays_zip(
        F.col(f"{found}.starts").alias("start"),
        F.col(f"{found}.lengths").alias("length"),
        F.col(f"{found}.periods").alias("period"),
    )
    return made.select(*[plain[c] for c in plain.columns], runs.alias("runs"), F.col(f"{found}.collapsed").alias("collapsed"))


def best_run(runs: Column) -> Column:
    """The run of greatest length / period, exactly; ties to the smaller start, then period."""
    empty = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    return F.aggregate(
        runs,
        empty,
        lambda best, r: F.when(
            best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r
        ).otherwise(best),
    )
