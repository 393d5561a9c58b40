"""Finding every window of ``width`` tokens that occurs more than once.

Each window of tokens has an *anchor*: the smallest hash of the ``gram``-token
strings inside it, the leftmost on ties. Equal windows have equal anchors, so

1. consecutive windows with the same anchor position form a segment, and a task
   sends one row (anchor, hash of the whole segment) instead of one per window;
2. a segment whose anchor occurs once can't hold a repeated window and is left out;
3. if all segments of an anchor are equal, all their windows repeat alike;
4. only segments of anchors with several different segments (where copies
   begin, end or differ) are looked at window by window.

No window is lost and no key needs all its rows in one task: anchors and windows
are counted by aggregates that combine in each task first, and rows get their
counts back by joins that Spark may split.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splitlane.llm import arrays as A
from splitlane.llm.tables import in_small_batches, text_key
from splitlane.session import settle

SEGMENTS = "doc_id long, tkey long, start long, n int, off int, anchor long, seg long"
_POSITION_BITS = 22
_CHUNK = 1 << 21  # windows of one text that are looked at together


@dataclass(frozen=True)
class Windows:
    """What is compared: words or bytes, how many make a window, how many an anchor."""

    width: int
    gram: int
    words: bool

    @property
    def base(self) -> np.uint64:
        return A.WORD_BASE if self.words else A.BYTE_BASE

    def tokens(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token values of a batch, and where the tokens of each text begin."""
        if not self.words:
            return data.astype(np.uint64) + np.uint64(1), off
        starts, ends, first = A.word_table(data, off)
        return A.word_hashes(data, starts, ends), first


def _leftmost_minimum(hashes: np.ndarray, span: int) -> np.ndarray:
    """Where the smallest of each ``span`` consecutive hashes is."""
    low = np.uint64((1 << _POSITION_BITS) - 1)
    packed = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
    n, reach = len(hashes) - span + 1, 1
    while reach * 2 <= span:
        packed = np.minimum(packed[:-reach], packed[reach:])
        reach *= 2
    if reach < span:
        packed = np.minimum(packed[:n], packed[span - reach : span - reach + n])
    return (packed[:n] & low).astype(np.int64)


def _pieces(first: np.ndarray, width: int) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
    """Runs of whole texts, or parts of a very long one, that fit the position bits.

    Gives token range and, per part, (text, first token). Parts of one text overlap
    by ``width - 1`` tokens, so each window lies in one part.
    """
    row, rows = 0, len(first) - 1
    while row < rows:
        if first[row + 1] - first[row] > _CHUNK + width:
            for at in range(int(first[row]), int(first[row + 1]) - width + 1, _CHUNK):
                yield at, min(at + _CHUNK + width - 1, int(first[row + 1])), [(row, at)]
            row += 1
            continue
        to = row + 1
        while to < rows and first[to + 1] - first[row] <= _CHUNK + width:
            to += 1
        yield int(first[row]), int(first[to]), [(r, int(first[r])) for r in range(row, to)]
        row = to


def segments_of(tokens: np.ndarray, first: np.ndarray, w: Windows) -> tuple[np.ndarray, ...]:
    """(text, first window, windows, place of the anchor, anchor, hash of the tokens) of every segment."""
    out: list[tuple[np.ndarray, ...]] = []
    for lo, hi, parts in _pieces(first, w.width):
        if hi - lo < w.width:
            continue
        piece = tokens[lo:hi]
        grams = A.window_hashes(piece, w.base, w.gram)
        best = _leftmost_minimum(grams, w.width - w.gram + 1)
        begins = np.array([at - lo for _, at in parts] + [hi - lo], np.int64)
        # A window must not reach into the next text.
        last = np.repeat(begins[1:] - w.width, np.diff(begins))[: len(best)]
        here = np.arange(len(best))
        fits = here <= last
        new = np.ones(len(best), bool)
        new[1:] = best[1:] != best[:-1]
        new[begins[:-1][begins[:-1] < len(best)]] = True
        new |= ~fits
        heads = np.flatnonzero(new)
        n = np.diff(np.append(heads, len(best)))
        heads, n = heads[fits[heads]], n[fits[heads]]
        part = np.searchsorted(begins, heads, "right") - 1
        texts = np.array([r for r, _ in parts], np.int64)[part]
        out.append(
            (
                texts,
                heads + lo - first[texts],
                n,
                best[heads] - heads,
                grams[best[heads]],
                A.span_hashes(piece, w.base, heads, heads + n + w.width - 1) + n.astype(np.uint64),
            )
        )
    if not out:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64))
    return tuple(np.concatenate(x) for x in zip(*out))


def _segment_rows(w: Windows) -> Callable:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in A.slices(batches, "text"):
            tokens, first = w.tokens(*A.text_buffers(batch.column(2)))
            text, start, n, place, anchor, seg = segments_of(tokens, first, w)
            ids = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids[0][text], pa.int64()),
                    pa.array(ids[1][text], pa.int64()),
                    pa.array(start, pa.int64()),
                    pa.array(n, pa.int32()),
                    pa.array(place, pa.int32()),
                    pa.array(anchor.view(np.int64)),
                    pa.array(seg.view(np.int64)),
                ],
                ["doc_id", "tkey", "start", "n", "off", "anchor", "seg"],
            )

    return rows


@dataclass(frozen=True)
class Repeats:
    """Segments whose anchor repeats: ``even`` ones (all equal) and ``mixed`` ones."""

    even: DataFrame
    mixed: DataFrame


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, tkey, text: rows equal in all three are treated alike, whatever their number."""
    return in_small_batches(docs).select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc_id"),
        text_key(F.col("text")).alias("tkey"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )


def find_repeats(docs: DataFrame, w: Windows) -> Repeats:
    """Segments of ``docs`` (as of keyed()) with a repeated anchor.

    Both results hold doc_id, tkey, start, n, off, anchor, seg; ``even`` also the smallest
    doc_id of its anchor.
    """
    segs = settle(docs.mapInArrow(_segment_rows(w), SEGMENTS), "segments")
    anchors = settle(
        segs.groupBy("anchor")
        .agg(
            F.count(F.lit(1)).alias("times"),
            F.min("seg").alias("low"),
            F.max("seg").alias("high"),
            F.min("doc_id").alias("least"),
        )
        .filter("times > 1")
        .select("anchor", (F.col("low") == F.col("high")).alias("same"), "least"),
        "anchors",
    )
    hits = settle(segs.join(anchors, "anchor"), "hits")
    return Repeats(
        hits.filter("same").drop("same"),
        hits.filter("not same").drop("same", "least"),
    )
