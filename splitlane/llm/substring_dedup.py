"""Substring dedup: repeated windows of words, cut out of all but the first document.

Rabin-Karp hashes of every window are taken in the tasks that read the texts and
counted in Spark; covered words merge into maximal removal intervals.
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
from splitlane.llm.tables import text_key
from splitlane.session import settle

WIDTH = 50
GRAM = 12
PIECES = "array<struct<start:bigint,n:int,anchor:bigint,seg:bigint>>"
WINDOW_ROWS = "anchor long, seg long, at int, window long, least long"
RESULT = T.StructType(
    [
        T.StructField("kept", T.StringType()),
        T.StructField("n_words", T.LongType()),
        T.StructField("n_removed", T.LongType()),
    ]
)


def pieces_with_text(mixed: DataFrame, texts: DataFrame, *more) -> DataFrame:
    """One row per text that represents mixed segments: its text and those segments.

    Of equal segments the one in the smallest doc_id stands for all. The list of a
    text is no longer than the text.
    """
    one = mixed.groupBy("anchor", "seg", "n").agg(
        F.min(F.struct("doc_id", "tkey", "start")).alias("at"), *more
    )
    extra = [c for c in one.columns if c not in ("anchor", "seg", "n", "at")]
    lists = one.groupBy(F.col("at.doc_id").alias("doc_id"), F.col("at.tkey").alias("tkey")).agg(
        F.collect_list(F.struct(F.col("at.start").alias("start"), "n", "anchor", "seg", *extra)).alias("pieces")
    )
    return lists.join(texts.dropDuplicates(["doc_id", "tkey"]), ["doc_id", "tkey"])


def piece_columns(column: pa.Array) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """The row of each listed piece, and the fields of the pieces."""
    rows = np.repeat(np.arange(len(column)), np.diff(column.offsets.to_numpy()))
    flat = column.flatten()
    return rows, {f.name: flat.field(f.name).to_numpy(zero_copy_only=False) for f in flat.type}


def _window_rows(w: Windows):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in A.slices(batches, "text"):
            tokens, first = w.tokens(*A.text_buffers(batch.column(2)))
            row, piece = piece_columns(batch.column(1))
            n = piece["n"].astype(np.int64)
            at = A.grouped_ranges(np.zeros(len(n), np.int64), n)
            hashes = A.window_hashes(tokens, w.base, w.width)[np.repeat(first[row] + piece["start"], n) + at]
            ids = batch.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(piece["anchor"], n)),
                    pa.array(np.repeat(piece["seg"], n)),
                    pa.array(at.astype(np.int32)),
                    pa.array(hashes.view(np.int64)),
                    pa.array(np.repeat(ids[row], n)),
                ],
                ["anchor", "seg", "at", "window", "least"],
            )

    return rows


def removal_windows(docs: DataFrame, w: Windows) -> DataFrame:
    """doc_id, tkey, spans: runs of windows that also start in a document with a smaller doc_id."""
    texts = keyed(docs.filter(F.col("doc_id").isNotNull()))
    found = find_repeats(texts, w)
    later = found.even.filter(F.col("least") < F.col("doc_id")).select(
        "doc_id", "tkey", F.array(F.struct("start", F.col("n").cast("long").alias("n"))).alias("spans")
    )
    windows = settle(
        pieces_with_text(found.mixed, texts)
        .select("doc_id", F.col("pieces").cast(PIECES).alias("pieces"), "text")
        .mapInArrow(_window_rows(w), WINDOW_ROWS),
        "windows",
    )
    firsts = settle(windows.groupBy("anchor", "window").agg(F.min("least").alias("first")), "firsts")
    per_piece = settle(
        windows.join(firsts, ["anchor", "window"])
        .groupBy("anchor", "seg")
        .agg(F.collect_list(F.struct("at", "first")).alias("firsts")),
        "pieces",
    )
    partly = (
        found.mixed.join(per_piece, ["anchor", "seg"])
        .withColumn("gone", F.expr("filter(firsts, f -> f.first < doc_id)"))
        .filter(F.size("gone") > 0)
        .select("doc_id", "tkey", F.expr("transform(gone, f -> struct(start + f.at as start, 1L as n))").alias("spans"))
    )
    return (
        later.unionByName(partly)
        .groupBy("doc_id", "tkey")
        .agg(F.flatten(F.collect_list("spans")).alias("spans"))
    )


def covered(size: int, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Which of ``size`` places lie in any of the ranges."""
    steps = np.zeros(size + 1, np.int32)
    np.add.at(steps, starts, 1)
    np.add.at(steps, stops, -1)
    return np.cumsum(steps[:-1]) > 0


def _cutter(width: int):
    @F.arrow_udf(RESULT)
    def cut(text: pa.Array, spans: pa.Array) -> pa.Array:
        kept, n_words, n_removed = [], [], []
        ends = spans.offsets.to_numpy()
        valid = spans.is_valid().to_numpy(zero_copy_only=False)
        start = spans.values.field("start").to_numpy(zero_copy_only=False)
        n = spans.values.field("n").to_numpy(zero_copy_only=False)
        data, off = A.text_buffers(text)
        raw = data.tobytes()
        for i in range(len(text)):
            words = raw[off[i] : off[i + 1]].split()
            n_words.append(len(words))
            if valid[i] and ends[i + 1] > ends[i]:
                s = start[ends[i] : ends[i + 1]]
                gone = covered(len(words), s, s + n[ends[i] : ends[i + 1]] + width - 1)
                words = [words[k] for k in np.flatnonzero(~gone)]
            n_removed.append(n_words[-1] - len(words))
            kept.append(b" ".join(words).decode("utf-8", "replace"))
        return pa.StructArray.from_arrays(
            [pa.array(kept, pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())],
            ["kept", "n_words", "n_removed"],
        )

    return cut


def substring_dedup(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """``docs`` with ``kept`` (words left, joined by one space), ``n_words`` and ``n_removed``.

    A window is ``width`` consecutive words of one document; every word covered by a
    window whose words also start in a document with a smaller doc_id goes. Windows are
    judged on the input. Null text is empty. Rows without a doc_id lose nothing and
    cost nobody a word. Rows sharing a doc_id don't cost each other words. Texts
    shorter than a window stay whole. Columns named like the three results are replaced.
    """
    w = Windows(width, min(gram, width), True)
    spans = removal_windows(docs, w).withColumnsRenamed(
        {"doc_id": "_of_doc", "tkey": "_of_text", "spans": "_spans"}
    )
    plain = docs.drop("kept", "n_words", "n_removed")
    joined = plain.join(
        spans,
        (plain["doc_id"] == spans["_of_doc"]) & (text_key(plain["text"]) == spans["_of_text"]),
        "left",
    )
    cut = _cutter(width)(F.coalesce("text", F.lit("")), F.coalesce("_spans", F.expr("cast(array() as array<struct<start:bigint,n:bigint>>)")))
    return joined.withColumn("_cut", cut).select(*plain.columns, "_cut.kept", "_cut.n_words", "_cut.n_removed")
