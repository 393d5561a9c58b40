"""Suffix-array dedup: every byte covered by a long string that occurs elsewhere.

The suffixes sorted are those that begin at anchors (see repeats.py): a repeated
string of ``width`` bytes has the same anchor at the same place in all its
occurrences, so no repeat is missed. Spark's sampled splitters range-partition these
suffixes by their leading bytes; each bucket sorts its suffixes, and the reversed
bytes before them, by multikey quicksort, and lengths of common prefixes of
neighbours tell which strings agree. A group of equal leading bytes too large for one
bucket is cut into several, and its strings are compared across their boundaries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from splitlane.llm import arrays as A
from splitlane.llm.repeats import Windows, find_repeats, keyed
from splitlane.llm.substring_dedup import covered, piece_columns, pieces_with_text
from splitlane.llm.tables import text_key
from splitlane.session import settle

WIDTH = 200
GRAM = 80
BUCKET_PIECES = 10_000
SUFFIXES = "lead binary, seg long, anchor long, off int, n int, times long, piece binary"
FOUND = "anchor long, seg long, at int, n int, window long, times long"
SPAN_LIST = "array<struct<start:bigint,n:bigint>>"
RESULT = T.StructType(
    [
        T.StructField("kept", T.BinaryType()),
        T.StructField("n_bytes", T.LongType()),
        T.StructField("n_removed", T.LongType()),
        T.StructField("n_spans", T.LongType()),
    ]
)


def _suffix_rows(width: int, gram: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in A.slices(batches, "text"):
            data, off = A.text_buffers(batch.column(1))
            row, piece = piece_columns(batch.column(0))
            begin = off[row] + piece["start"]
            size = piece["n"].astype(np.int64) + width - 1
            flat = data[A.grouped_ranges(begin, size)]
            ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
            leads = data[A.grouped_ranges(begin + piece["off"], np.full(len(begin), gram))]
            binary = lambda ends, flat: pa.Array.from_buffers(
                pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(flat.tobytes())]
            )
            lead_ends = (np.arange(len(begin) + 1) * gram).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    binary(lead_ends, leads),
                    *(pa.array(piece[k]) for k in ("seg", "anchor", "off", "n", "times")),
                    binary(ends, flat),
                ],
                ["lead", "seg", "anchor", "off", "n", "times", "piece"],
            )

    return rows


def multikey_order(keys: np.ndarray) -> np.ndarray:
    """Order of the rows of a matrix of unsigned words, column after column.

    As in multikey quicksort, only rows that agree so far are sorted by the next word.
    """
    order = np.argsort(keys[:, 0], kind="stable")
    group = np.zeros(len(keys), np.int64)
    group[1:] = np.cumsum(keys[order[1:], 0] != keys[order[:-1], 0])
    for column in range(1, keys.shape[1]):
        tied = np.zeros(len(keys), bool)
        same = group[1:] == group[:-1]
        tied[1:] |= same
        tied[:-1] |= same
        at = np.flatnonzero(tied)
        if not len(at):
            break
        word = keys[order[at], column]
        inner = np.lexsort((word, group[at]))
        order[at] = order[at[inner]]
        sorted_word = word[inner]
        split = np.zeros(len(keys), np.int64)
        split[at[1:]] = (sorted_word[1:] != sorted_word[:-1]) & (group[at[1:]] == group[at[:-1]])
        group += np.cumsum(split)
    return order


def _prefix_classes(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of byte rows, and the length of the prefix that each shares with the one before it."""
    wide = -rows.shape[1] % 8
    padded = np.pad(rows, ((0, 0), (0, wide)))
    order = multikey_order(np.ascontiguousarray(padded).view(">u8").astype(np.uint64))
    differs = rows[order[1:]] != rows[order[:-1]]
    shared = np.where(differs.any(axis=1), differs.argmax(axis=1), rows.shape[1])
    return order, np.concatenate([[0], shared])


def _classes_at(order: np.ndarray, shared: np.ndarray, depth: int) -> np.ndarray:
    """For each row a number that rows with the same first ``depth`` bytes share."""
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(shared < depth) if depth else 0
    return out


def _matrix(data: np.ndarray, begin: np.ndarray, size: np.ndarray, width: int, step: int) -> np.ndarray:
    """Row i holds size[i] bytes from begin[i] on (backwards if step is -1), then zeros."""
    out = np.zeros((len(begin), width), np.uint8)
    size = np.minimum(size, width)
    row = np.repeat(np.arange(len(begin)), size)
    col = A.grouped_ranges(np.zeros(len(begin), np.int64), size)
    out[row, col] = data[begin[row] + step * col]
    return out


def repeated_windows(data, ends, place, n, times, width: int, gram: int):
    """(piece, window) pairs whose ``width`` bytes occur at least twice, by ``times``, in this bucket."""
    begin, size = ends[:-1], np.diff(ends)
    reach = width - gram + 1
    right = _prefix_classes(_matrix(data, begin + place, size - place, width, 1))
    left = _prefix_classes(_matrix(data, begin + place - 1, place, max(reach, 1), -1))
    pieces, windows = [], []
    for before in range(reach):  # bytes of the string before its anchor
        fit = np.flatnonzero((before <= place) & (before > place - n))
        if len(fit) == 0:
            continue
        key = _classes_at(*left, before)[fit] * (len(place) + 1) + _classes_at(*right, width - before)[fit]
        by = np.argsort(key)
        heads = np.flatnonzero(np.concatenate([[True], np.diff(key[by]) != 0]))
        total = np.add.reduceat(times[fit][by], heads)
        again = by[np.repeat(total >= 2, np.diff(np.append(heads, len(by))))]
        pieces.append(fit[again])
        windows.append(place[fit[again]] - before)
    if not pieces:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(pieces), np.concatenate(windows)


def _bucket(width: int, gram: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]  # a bucket holds BUCKET_PIECES pieces or so
        if not held:
            return
        table = pa.Table.from_batches(held)
        column = lambda k: table[k].to_numpy()
        piece = table["piece"].combine_chunks().cast(pa.large_binary())
        _, offsets, raw = piece.buffers()
        ends = np.frombuffer(offsets, np.int64)[piece.offset : piece.offset + len(piece) + 1]
        data = np.frombuffer(raw, np.uint8)
        place, n, times = (column(k).astype(np.int64) for k in ("off", "n", "times"))
        anchor, seg, parts = column("anchor"), column("seg"), column("parts")
        at_piece, at = repeated_windows(data, ends, place, n, times, width, gram)
        cells = np.sort(at_piece * (1 << 20) + at)
        heads = np.flatnonzero(np.concatenate([[True], np.diff(cells) != 1])) if len(cells) else np.zeros(0, np.int64)
        run = np.diff(np.append(heads, len(cells)))
        of, first = cells[heads] >> 20, cells[heads] & ((1 << 20) - 1)
        # Strings of groups cut into parts go to the comparison across boundaries: those that
        # are single in this bucket to be told whether they repeat, of the others one each.
        outer = np.flatnonzero(parts > 1)
        where = A.grouped_ranges(np.zeros(len(outer), np.int64), n[outer])
        back = np.repeat(outer, n[outer])
        base, top = int(ends[0]), int(ends[-1])
        hashes = A.window_hashes(data[base:top].astype(np.uint64) + np.uint64(1), A.BYTE_BASE, width)
        window = hashes[ends[back] - base + where].view(np.int64)
        again = np.isin(back * (1 << 20) + where, cells)
        one = np.zeros(len(window), bool)
        one[np.unique(window, return_index=True)[1]] = True
        sent = ~again | one
        back, where, window, told = back[sent], where[sent], window[sent], again[sent]
        both = lambda a, b: pa.array(np.concatenate([a, b]))
        yield pa.RecordBatch.from_arrays(
            [
                both(anchor[of], anchor[back]),
                both(seg[of], seg[back]),
                both(first.astype(np.int32), where.astype(np.int32)),
                both(run.astype(np.int32), np.where(told, 0, 1).astype(np.int32)),
                pa.array(
                    np.concatenate([np.zeros(len(of), np.int64), window]),
                    mask=np.arange(len(of) + len(back)) < len(of),
                ),
                both(np.full(len(of), 2), np.where(told, 2, times[back])),
            ],
            ["anchor", "seg", "at", "n", "window", "times"],
        )

    return rows


def repeated_spans(docs: DataFrame, width: int, gram: int) -> DataFrame:
    """doc_id, tkey, spans: runs of starts whose ``width`` bytes also start elsewhere."""
    texts = keyed(docs)
    found = find_repeats(texts, Windows(width, gram, False))
    with_text = pieces_with_text(
        found.mixed, texts, F.first("off").alias("off"), F.count(F.lit(1)).alias("times")
    )
    suffixes = settle(
        with_text.select("pieces", "text").mapInArrow(_suffix_rows(width, gram), SUFFIXES), "suffixes"
    )
    groups = suffixes.groupBy("anchor").agg(F.count(F.lit(1)).alias("all"))
    large = groups.filter(F.col("all") > BUCKET_PIECES).select(
        "anchor", (F.floor(F.col("all") / BUCKET_PIECES) + 1).alias("parts")
    )
    cut = suffixes.join(large, "anchor", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    buckets = max(suffixes.count() // BUCKET_PIECES + 1, 1)
    sorted_out = settle(
        cut.repartitionByRange(buckets, "lead", F.pmod("seg", "parts"))
        .select("seg", "anchor", "off", "n", "times", "parts", "piece")
        .mapInArrow(_bucket(width, gram), FOUND),
        "found",
    )
    edges = sorted_out.filter("window is not null")
    across = settle(edges.groupBy("anchor", "window").agg(F.sum("times").alias("all")).filter("all > 1"), "across")
    per_piece = settle(
        sorted_out.filter("window is null")
        .select("anchor", "seg", "at", "n")
        .unionByName(edges.filter("n > 0").join(across, ["anchor", "window"]).select("anchor", "seg", "at", "n"))
        .groupBy("anchor", "seg")
        .agg(F.collect_list(F.struct("at", "n")).alias("runs")),
        "runs",
    )
    some = found.mixed.join(per_piece, ["anchor", "seg"]).select(
        "doc_id", "tkey", F.expr("transform(runs, r -> struct(start + r.at as start, cast(r.n as bigint) as n))").alias("spans")
    )
    whole = found.even.select(
        "doc_id", "tkey", F.array(F.struct("start", F.col("n").cast("long").alias("n"))).alias("spans")
    )
    return (
        whole.unionByName(some).groupBy("doc_id", "tkey").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    )


def _cutter(width: int):
    @F.arrow_udf(RESULT)
    def cut(text: pa.Array, spans: pa.Array) -> pa.Array:
        kept, removed, runs = [], [], []
        ends = spans.offsets.to_numpy()
        start = spans.values.field("start").to_numpy(zero_copy_only=False)
        n = spans.values.field("n").to_numpy(zero_copy_only=False)
        data, off = A.text_buffers(text)
        for i in range(len(text)):
            raw = data[off[i] : off[i + 1]]
            if ends[i + 1] > ends[i]:
                s = start[ends[i] : ends[i + 1]]
                gone = covered(len(raw), s, s + n[ends[i] : ends[i + 1]] + width - 1)
                removed.append(int(gone.sum()))
                runs.append(int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()))
                raw = raw[~gone]
            else:
                removed.append(0)
                runs.append(0)
            kept.append(raw.tobytes())
        return pa.StructArray.from_arrays(
            [
                pa.array(kept, pa.binary()),
                pa.array(np.diff(off)),
                pa.array(removed, pa.int64()),
                pa.array(runs, pa.int64()),
            ],
            ["kept", "n_bytes", "n_removed", "n_spans"],
        )

    return cut


def suffix_dedup(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """``docs`` with ``kept`` (bytes left), ``n_bytes``, ``n_removed``, ``n_spans`` (runs removed).

    A byte goes if it is covered by ``width`` consecutive bytes of its text that also
    start anywhere else, in the same text or another; strings are judged on the input and
    may overlap. Null text is empty; rows without a doc_id take part; repeated rows
    repeat each other. ``kept`` is binary, as a cut may fall inside a character. Columns
    named like the four results are replaced.
    """
    spans = repeated_spans(docs, width, min(gram, width)).withColumnsRenamed(
        {"doc_id": "_of_doc", "tkey": "_of_text", "spans": "_spans"}
    )
    plain = docs.drop("kept", "n_bytes", "n_removed", "n_spans")
    joined = plain.join(
        spans,
        (F.coalesce(plain["doc_id"].cast("long"), F.lit(-(1 << 63))) == spans["_of_doc"])
        & (text_key(plain["text"]) == spans["_of_text"]),
        "left",
    )
    cut = _cutter(width)(F.coalesce("text", F.lit("")), F.coalesce("_spans", F.expr(f"cast(array() as {SPAN_LIST})")))
    return joined.withColumn("_cut", cut).select(
        *plain.columns, "_cut.kept", "_cut.n_bytes", "_cut.n_removed", "_cut.n_spans"
    )
