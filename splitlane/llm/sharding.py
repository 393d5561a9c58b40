"""Sharding: documents into a fixed number of shards under one of three laws.

* ``bytes``: shard sizes near equal. Groups of equal texts are indivisible. Groups are
  dealt into buckets by hash; each bucket (at most about ``GROUPS_PER_BUCKET`` groups,
  one task) is balanced by Karmarkar-Karp differencing: every group starts as a
  partial partition with its size in one shard, and the two partial partitions with
  the largest spread are combined, one ordered up and the other down, until one is
  left. The buckets' partial partitions (one row per bucket and shard) are then
  differenced the same way, which names the shard of every bucket's part.
* ``rows``: row i of the order (doc_id, crc32, size) goes to shard i mod n.
* ``key``: rendezvous hashing of doc_id: the shard whose hash with the doc_id is
  largest. With one more shard, rows move only into the new one.

Slots number the rows of each shard from 0 in that order, by a prefix sum over range
partitions: no task holds a whole shard.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from splitlane.session import settle

SHARDS = 40
# Bytes a row costs beyond its text.
PAD = 16
# Groups of equal texts that one task balances.
GROUPS_PER_BUCKET = 50_000
LAWS = ("bytes", "rows", "key")
OUT = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")
ORDER = ("doc_id", "text_crc32", "size")


def difference(parts: list[tuple[list[int], list[int]]], k: int) -> list[tuple[int, list[int]]]:
    """Karmarkar-Karp differencing of partial partitions.

    ``parts`` holds partial partitions as (sums, labels): k sums, and for each sum the
    label of what it holds (-1: nothing). Returns the k (sum, labels) of the result,
    largest first; labels of one sum were combined into it.
    """
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while parent.get(root, root) != root:
            root = parent[root]
        while parent.get(x, x) != root:
            parent[x], x = root, parent[x]
        return root

    heap = []
    for n, (sums, labels) in enumerate(parts):
        cells = sorted(zip(sums, labels), key=lambda c: (-c[0], c[1]))
        heapq.heappush(heap, (-(cells[0][0] - cells[-1][0]), n, cells))
    if not heap:
        return []
    made = len(parts)
    while len(heap) > 1:
        _, _, big = heapq.heappop(heap)
        _, _, other = heapq.heappop(heap)
        merged = []
        for (s1, l1), (s2, l2) in zip(big, reversed(other)):
            if l1 < 0 or l2 < 0:
                label = max(l1, l2)
            else:
                label = find(l1)
                parent[find(l2)] = label
            merged.append((s1 + s2, label))
        merged.sort(key=lambda c: (-c[0], c[1]))
        heapq.heappush(heap, (-(merged[0][0] - merged[-1][0]), made, merged))
        made += 1
    cells = heap[0][2]
    members: dict[int, list[int]] = {}
    for x in {x for _, labels in parts for x in labels if x >= 0}:
        members.setdefault(find(x), []).append(x)
    return [(s, sorted(members.get(label, [])) if label >= 0 else []) for s, label in cells]


def _balance_bucket(k: int):
    def balance(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["bytes", "k1", "k2", "n"], ascending=[False, True, True, True], ignore_index=True)
        parts = [([int(b)] + [0] * (k - 1), [i] + [-1] * (k - 1)) for i, b in enumerate(rows["bytes"].tolist())]
        local = [0] * len(rows)
        for j, (_, members) in enumerate(difference(parts, k)):
            for i in members:
                local[i] = j
        out = rows[["bucket", "k1", "k2", "n", "bytes"]].copy()
        out["local"] = local
        return out

    return balance


def _slots(rows: DataFrame, by: str) -> DataFrame:
    """``rows`` with ``slot``: its place in its ``by`` group by ORDER, from 0, without gaps."""
    spread = settle(
        rows.repartitionByRange(by, *ORDER).withColumn("_part", F.spark_partition_id()), "sharded"
    )
    within = Window.partitionBy(by, "_part").orderBy(*ORDER)
    counted = spread.groupBy(by, "_part").agg(F.count(F.lit(1)).alias("_rows"))
    # One row per shard and range partition: a bounded table.
    before = counted.withColumn(
        "_before",
        F.coalesce(
            F.sum("_rows").over(Window.partitionBy(by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)),
            F.lit(0),
        ),
    ).drop("_rows")
    placed = spread.withColumn("_at", F.row_number().over(within) - 1)
    return placed.join(F.broadcast(before), [by, "_part"]).withColumn("slot", (F.col("_before") + F.col("_at")).cast("long")).drop(
        "_part", "_before", "_at"
    )


def rendezvous(key: Column, shards: int) -> Column:
    """The shard in 0 .. shards - 1 whose hash with ``key`` is largest."""
    tried = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.struct(F.xxhash64(key, s).alias("h"), s.alias("s")))
    return F.array_max(tried)["s"].cast("int")


def _bytes_shards(rows: DataFrame, k: int) -> DataFrame:
    groups = settle(
        rows.groupBy("k1", "k2", "n").agg(F.sum("size").alias("bytes")),
        "groups",
    )
    buckets = max(1, -(-groups.count() // GROUPS_PER_BUCKET))
    local = settle(
        groups.withColumn("bucket", F.pmod(F.col("k1"), F.lit(buckets)))
        .groupBy("bucket")
        .applyInPandas(_balance_bucket(k), "bucket long, k1 long, k2 long, n long, bytes long, local int"),
        "balanced",
    )
    # One row per bucket and shard: bounded by the buckets, not by the rows.
    sums = local.groupBy("bucket", "local").agg(F.sum("bytes").alias("bytes")).collect()
    by_bucket: dict[int, list[int]] = {}
    for r in sums:
        by_bucket.setdefault(r["bucket"], [0] * k)[r["local"]] = int(r["bytes"])
    names = sorted(by_bucket)
    parts = [(by_bucket[b], [b * k + j for j in range(k)]) for b in names]
    mapping = [(label // k, label % k, shard) for shard, (_, labels) in enumerate(difference(parts, k)) for label in labels]
    table = rows.sparkSession.createDataFrame(mapping, "bucket long, local int, shard int")
    placed = local.join(F.broadcast(table), ["bucket", "local"]).select("k1", "k2", "n", "shard")
    return rows.join(placed, ["k1", "k2", "n"])


def shard_documents(docs: DataFrame, shards: int = SHARDS, law: str = "bytes", text: str = "text") -> DataFrame:
    """Where each row of ``docs`` goes: doc_id and its other columns but ``text``, with OUT.

    ``size`` is the UTF-8 bytes of the text plus PAD (null text: PAD), ``text_crc32``
    the unsigned crc32 of its UTF-8 bytes (null: of no bytes), ``shard`` in 0 ..
    shards - 1 under ``law``, ``slot`` the place in the shard from 0 by (doc_id,
    text_crc32, size), ``grown_shard`` the shard with one more (``key`` only, else
    null). Under ``bytes`` equal texts share a shard (null text counts as empty). Null
    doc_ids are placed like the others (``key``: all in one shard). Repeated rows all
    stay; very long texts are only measured and hashed; an empty table gives an empty
    table. Columns of ``docs`` named like OUT are replaced.
    """
    if law not in LAWS:
        raise ValueError(f"law is one of {LAWS}")
    body = F.coalesce(F.col(text), F.lit(""))
    # Other columns travel in one struct, so that no name of theirs meets ours.
    extra = [c for c in docs.columns if c not in OUT and c not in (text, "doc_id")]
    rest = [F.struct(*[F.col(f"`{c}`") for c in extra]).alias("__rest")] if extra else []
    rows = docs.select(
        "doc_id",
        *rest,
        (F.octet_length(body) + PAD).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.xxhash64(body).alias("k1"),
        F.xxhash64(body, F.lit(7)).alias("k2"),
        F.octet_length(body).cast("long").alias("n"),
    )
    if law == "bytes":
        placed = _slots(_bytes_shards(rows, shards), "shard").withColumn("grown_shard", F.lit(None).cast("int"))
    elif law == "rows":
        ranked = _slots(rows.withColumn("_all", F.lit(0)), "_all").drop("_all")
        placed = (
            ranked.withColumn("shard", (F.col("slot") % shards).cast("int"))
            .withColumn("slot", F.floor(F.col("slot") / shards).cast("long"))
            .withColumn("grown_shard", F.lit(None).cast("int"))
        )
    else:
        keyed = rows.withColumn("shard", rendezvous(F.col("doc_id"), shards))
        placed = _slots(keyed, "shard").withColumn("grown_shard", rendezvous(F.col("doc_id"), shards + 1))
    return placed.select(
        "doc_id",
        *[F.col(f"__rest.`{c}`").alias(c) for c in extra],
        "size",
        "text_crc32",
        F.lit(law).alias("law"),
        "shard",
        "slot",
        "grown_shard",
    )
