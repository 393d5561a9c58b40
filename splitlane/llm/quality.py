"""Quality classifier by importance resampling.

Two generative models of hashed word and word-pair counts, one of target texts and one of
all texts, give each document the log of its likelihood ratio. Gumbel noise made from the
document's id is added, and the top ``keep`` share of all documents is kept: a sample
without replacement in proportion to the ratios. The cut is found from nested histograms.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splitlane.llm import arrays as A
from splitlane.llm.tables import id_order, in_small_batches
from splitlane.llm.thresholds import HASH_BITS, budget_cuts, hash60
from splitlane.session import settle

BUCKETS = 1 << 16
TARGETS = 20_000  # labelled documents that the target model may use
_KIND = np.full(256, 2, np.uint8)  # 0 space, 1 letter or digit, 2 sign
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_KIND[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def ngram_buckets(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of each word, run of signs, and pair of neighbours among them."""
    kind = _KIND[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[off] = True
    new = kind > 0
    new[1:] &= (kind[1:] != kind[:-1]) | cut[1:-1]
    stop = kind > 0
    stop[:-1] &= (kind[1:] != kind[:-1]) | cut[1:-1]
    starts, ends = np.flatnonzero(new), np.flatnonzero(stop) + 1
    words = A.word_hashes(_LOWER[data], starts, ends)
    first = np.searchsorted(starts, off)
    text = np.repeat(np.arange(len(off) - 1), np.diff(first))
    pairs = A.mix(words[:-1] * A.WORD_BASE + words[1:])
    same = text[1:] == text[:-1]
    hashes = np.concatenate([words, pairs[same]])
    return np.concatenate([text, text[1:][same]]), (hashes >> np.uint64(48)).astype(np.int64)


def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = np.zeros(BUCKETS, np.int64)
    for batch in A.slices(batches, "text"):
        seen += np.bincount(ngram_buckets(*A.text_buffers(batch.column(0)))[1], minlength=BUCKETS)
    at = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], ["bucket", "n"])


def ngram_model(texts: DataFrame) -> np.ndarray:
    """Log probability of every bucket, over all texts; BUCKETS numbers, however many texts there are."""
    table = texts.select("text").mapInArrow(_count_rows, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.ones(BUCKETS)
    counts[table["bucket"].to_numpy()] += table["n"].to_numpy()
    return np.log(counts / counts.sum())


def descending60(values: np.ndarray) -> np.ndarray:
    """60-bit numbers, the smaller the larger the value; values that agree in their first 60 bits tie."""
    bits = np.ascontiguousarray(values, np.float64).view(np.int64)
    ordered = bits ^ ((bits >> 63) & np.int64((1 << 63) - 1))
    unsigned = (ordered.view(np.uint64) ^ np.uint64(1 << 63)) >> np.uint64(64 - HASH_BITS)
    return (np.uint64((1 << HASH_BITS) - 1) - unsigned).astype(np.int64)


def _weight_rows(ratio: np.ndarray):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in A.slices(batches, "text"):
            text, bucket = ngram_buckets(*A.text_buffers(batch.column(1)))
            weight = np.bincount(text, ratio[bucket], minlength=batch.num_rows)
            u = (batch.column(2).to_numpy() + 0.5) / (1 << HASH_BITS)
            key = weight - np.log(-np.log(u))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(weight), pa.array(key), pa.array(descending60(key))],
                ["doc_id", "log_weight", "gumbel_key", "hash"],
            )

    return rows


def importance_resample(docs: DataFrame, labels: DataFrame, keep: float | None = None, targets: int = TARGETS) -> DataFrame:
    """doc_id, log_weight, gumbel_key, kept of every row of ``docs``.

    Target texts are those of at most ``targets`` documents labelled quality 1, first in the
    order of the md5 of their ids; without any, all ratios are 1. Null and empty texts have
    log_weight 0. ``keep`` is by default the share of quality 1 among all labels, or 1
    without labels. floor(keep * rows) rows are kept, or as near as ties in the key allow;
    rows sharing a doc_id share their noise, rows without one that of the empty id.
    """
    if keep is None:
        keep = labels.agg(F.avg((F.col("quality") == 1).cast("double"))).first()[0]
        keep = 1.0 if keep is None else keep
    good = labels.filter((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    chosen = good.orderBy(id_order(F.col("doc_id")), "doc_id").limit(targets)
    raw = ngram_model(in_small_batches(docs))
    target = ngram_model(docs.join(F.broadcast(chosen), "doc_id", "left_semi"))  # at most ``targets`` ids
    ratio = target - raw if chosen.take(1) else np.zeros(BUCKETS)
    kind = docs.schema["doc_id"].dataType.simpleString()
    weighed = settle(
        docs.select("doc_id", "text", hash60(F.col("doc_id")).alias("u")).mapInArrow(
            _weight_rows(ratio), f"doc_id {kind}, log_weight double, gumbel_key double, hash long"
        ),
        "weights",
    )
    budget = weighed.agg(F.lit(0).alias("grp"), F.floor(F.count(F.lit(1)) * keep).alias("budget"))
    cut = budget_cuts(
        weighed.select(F.lit(0).alias("grp"), "hash", F.lit(1).cast("long").alias("size")), settle(budget, "budget")
    ).first()
    return weighed.select("doc_id", "log_weight", "gumbel_key", (F.col("hash") < cut.cut).alias("kept"))
