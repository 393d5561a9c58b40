"""Conversation prefix trie: every distinct sequence of first turns is a node.

Each conversation becomes a row of turn ids (64-bit hashes of role and text). Rows are
range-partitioned by their turn ids, so that every partition holds a contiguous part of
the sorted order. Inside a partition the rows form a padded turn-id matrix; numpy's
lexsort orders it, the change mask of each column against the row above, OR-accumulated
along the columns, marks where nodes of every depth start, and reduceat sums each node's
rows. The last row of the partition before and the first of the one after are handed
in, so that marks are exact at the edges; a node that crosses an edge is given in parts
(at most two per depth and partition) that are added up afterwards.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splitlane.llm import arrays as A
from splitlane.session import settle

NODES = (
    "key long, parent_key long, depth long, n_convs long, conv_id long, n_children long, n_leaves long, "
    "saved_tokens long, ends string, partial boolean, parent_conv_id long, parent_partial boolean, part int"
)
OUT = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends")
KEY_BASE = np.uint64(0x9FB21C651E98DF25)


def _matrix(ids: list, lens: list, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(ids)
    sizes = np.fromiter((len(x) for x in ids), np.int64, n)
    rows = np.repeat(np.arange(n), sizes)
    cols = A.grouped_ranges(np.zeros(n, np.int64), sizes)
    m = np.zeros((n, width), np.int64)
    p = np.zeros((n, width), bool)
    length = np.zeros((n, width), np.int64)
    if len(rows):
        m[rows, cols] = np.concatenate(ids).astype(np.int64)
        length[rows, cols] = np.concatenate(lens).astype(np.int64)
        p[rows, cols] = True
    return m, p, length


def _edge(row, width: int) -> tuple[np.ndarray, np.ndarray] | None:
    """A neighbouring row's ids and presence, cut or padded to ``width``."""
    if row is None:
        return None
    ids = np.asarray(row[:width], np.int64)
    m, p = np.zeros(width, np.int64), np.zeros(width, bool)
    m[: len(ids)], p[: len(ids)] = ids, True
    return m, p


def _part_nodes(edges: dict[int, tuple]):
    def nodes(pdf: pd.DataFrame) -> pd.DataFrame:
        part = int(pdf["_part"].iloc[0])
        before, after = edges.get(part, (None, None))
        ids, lens = pdf["ids"].tolist(), pdf["lens"].tolist()
        size = np.fromiter((len(x) for x in ids), np.int64, len(ids))
        width = int(size.max())
        m, p, length = _matrix(ids, lens, width)
        conv = pdf["conv_id"].to_numpy(np.int64)
        keys = [conv]
        for j in reversed(range(width)):
            keys += [m[:, j], p[:, j]]
        order = np.lexsort(keys)
        m, p, length, conv, size = m[order], p[order], length[order], conv[order], size[order]
        n = len(conv)

        first = _edge(before, width)
        above_m = np.vstack([first[0] if first else np.zeros(width, np.int64), m[:-1]])
        above_p = np.vstack([first[1] if first else np.zeros(width, bool), p[:-1]])
        # Column change masks, OR-accumulated: True from the first column where a row parts from the one above.
        moved = np.logical_or.accumulate((m != above_m) | (p != above_p), axis=1)
        if first is None:
            moved[0, :] = True
        last = _edge(after, width)
        if last is None:
            tail = np.ones((1, width), bool)
        else:
            tail = np.logical_or.accumulate((m[-1:] != last[0]) | (p[-1:] != last[1]), axis=1)
        moved_next = np.vstack([moved[1:], tail])

        starts = p & moved
        # A leaf ends at the last row of its equal rows, where the next row parts from it.
        leaf = moved_next[np.arange(n), size - 1].astype(np.int64)
        uncounted = np.where(p & ~starts, length, 0)
        tails = np.cumsum(uncounted[:, ::-1], axis=1)[:, ::-1]
        key = np.zeros((n, width), np.uint64)
        running = np.zeros(n, np.uint64)
        for j in range(width):
            running = A.mix(running * KEY_BASE + m[:, j].view(np.uint64) + np.uint64(j + 1))
            key[:, j] = running
        out, parent_min, parent_partial, parent_cuts = [], None, None, None
        for j in range(width):
            cuts = np.union1d([0], np.flatnonzero(moved[:, j]))
            count = np.diff(np.append(cuts, n))
            least = np.minimum.reduceat(conv, cuts)
            children = np.add.reduceat(starts[:, j + 1].astype(np.int64), cuts) if j + 1 < width else np.zeros(len(cuts), np.int64)
            leaves = np.add.reduceat(leaf, cuts)
            saved = np.add.reduceat(tails[:, j], cuts)
            ending = np.add.reduceat((size == j + 1).astype(np.int64), cuts)
            partial = np.zeros(len(cuts), bool)
            partial[0] |= not moved[0, j]
            partial[-1] |= not tail[0, j]
            if j:
                up = np.searchsorted(parent_cuts, cuts, "right") - 1
                p_min, p_partial = parent_min[up], parent_partial[up]
            else:
                p_min, p_partial = np.full(len(cuts), -1, np.int64), np.zeros(len(cuts), bool)
            real = p[cuts, j]
            for c in np.flatnonzero(real).tolist():
                s = int(cuts[c])
                out.append(
                    (
                        int(key[s, j].view(np.int64)),
                        int(key[s, j - 1].view(np.int64)) if j else 0,
                        j + 1,
                        int(count[c]),
                        int(least[c]),
                        int(children[c]),
                        int(leaves[c]),
                        int(saved[c]),
                        ",".join(map(str, conv[s : s + int(ending[c])].tolist())),
                        bool(partial[c]),
                        None if (not j or p_partial[c]) else int(p_min[c]),
                        bool(p_partial[c]),
                        part,
                    )
                )
            parent_min, parent_partial, parent_cuts = least, partial, cuts
        return pd.DataFrame(out, columns=[f.split()[0] for f in NODES.split(", ")])

    return nodes


def conversation_trie(turns: DataFrame, conversations: DataFrame | None = None, order: str = "turn") -> DataFrame:
    """One row per node of the prefix trie of the conversations: OUT.

    ``turns`` holds (conv_id, ``order``, role, text); a conversation is its turns by
    ``order`` (null first), ties by role, then text. Null role or text is empty; rows
    without a conv_id are left out. ``conversations`` (conv_id) may add conversations
    without turns. A node is a distinct sequence of first d turns (role, text), from the
    root (d = 0); its members are the conversations starting with it. Per node:
    ``conv_id`` its smallest member, ``depth``, ``parent_conv_id`` (root: null),
    ``n_convs`` members, ``n_children``, ``n_leaves`` childless nodes in its subtree,
    ``saved_tokens`` summed over its subtree of (n_convs - 1) times the code points of a
    node's last text, ``ends`` the members with exactly d turns, ascending, joined by
    commas. Repeated turn rows count as turns. An empty table gives no nodes; very long
    conversations are one row of the matrix of their partition, whose width is the
    longest there. Extra columns are not read. Turns are told apart by 64-bit hashes.
    """
    spark = turns.sparkSession
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    cells = turns.filter(F.col("conv_id").isNotNull()).select(
        "conv_id", F.col(order).alias("_o"), role.alias("_r"), text.alias("_t")
    )
    per_conv = cells.groupBy("conv_id").agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    F.col("_o").isNotNull().alias("o0"),
                    F.col("_o").alias("o1"),
                    F.col("_r").alias("o2"),
                    F.col("_t").alias("o3"),
                    F.xxhash64("_r", "_t").alias("id"),
                    F.char_length("_t").cast("long").alias("len"),
                )
            )
        ).alias("_seq")
    )
    seqs = per_conv.select("conv_id", F.col("_seq.id").alias("ids"), F.col("_seq.len").alias("lens"))
    if conversations is not None:
        known = conversations.filter(F.col("conv_id").isNotNull()).select("conv_id").distinct()
        seqs = known.join(seqs, "conv_id", "full").select(
            "conv_id",
            F.coalesce("ids", F.expr("cast(array() as array<bigint>)")).alias("ids"),
            F.coalesce("lens", F.expr("cast(array() as array<bigint>)")).alias("lens"),
        )
    seqs = settle(seqs, "conversations")
    root = seqs.agg(
        F.count(F.lit(1)).alias("n_convs"),
        F.min("conv_id").alias("conv_id"),
        F.array_join(
            F.array_sort(F.collect_list(F.when(F.size("ids") == 0, F.col("conv_id")))).cast("array<string>"), ","
        ).alias("ends"),
    ).collect()[0]
    if not root["n_convs"]:
        return spark.createDataFrame([], ", ".join(f"{c} {'string' if c == 'ends' else 'long'}" for c in OUT))
    spread = settle(
        seqs.filter(F.size("ids") > 0)
        .repartitionByRange("ids", "conv_id")
        .withColumn("_part", F.spark_partition_id()),
        "ranged",
    )
    # The first and last row of each partition: two rows per partition.
    ends_of = spread.groupBy("_part").agg(
        F.min(F.struct("ids", "conv_id")).alias("lo"), F.max(F.struct("ids", "conv_id")).alias("hi")
    ).collect()
    ends_of = sorted(ends_of, key=lambda r: r["_part"])
    edges = {
        r["_part"]: (
            ends_of[i - 1]["hi"]["ids"] if i else None,
            ends_of[i + 1]["lo"]["ids"] if i + 1 < len(ends_of) else None,
        )
        for i, r in enumerate(ends_of)
    }
    nodes = settle(spread.groupBy("_part").applyInPandas(_part_nodes(edges), NODES), "nodes")
    pieces = nodes.filter("partial").groupBy("key").agg(
        F.first("parent_key").alias("parent_key"),
        F.first("depth").alias("depth"),
        F.sum("n_convs").alias("n_convs"),
        F.min("conv_id").alias("conv_id"),
        F.sum("n_children").alias("n_children"),
        F.sum("n_leaves").alias("n_leaves"),
        F.sum("saved_tokens").alias("saved_tokens"),
        F.array_join(
            F.filter(
                F.transform(F.array_sort(F.collect_list(F.struct("part", "ends"))), lambda x: x["ends"]),
                lambda e: e != "",
            ),
            ",",
        ).alias("ends"),
        F.lit(None).cast("long").alias("parent_conv_id"),
        F.lit(True).alias("parent_partial"),
    )
    # Nodes crossing an edge: at most two per depth and partition.
    crossing = settle(pieces, "crossing")
    whole = nodes.filter(~F.col("partial")).drop("partial", "part").unionByName(crossing)
    parents = crossing.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("_parent"))
    linked = whole.join(F.broadcast(parents), "parent_key", "left").select(
        *[c for c in OUT if c != "parent_conv_id"],
        F.when(F.col("depth") == 1, F.lit(root["conv_id"]))
        .when(F.col("parent_partial"), F.col("_parent"))
        .otherwise(F.col("parent_conv_id"))
        .alias("parent_conv_id"),
    )
    first = whole.filter(F.col("depth") == 1).agg(
        F.count(F.lit(1)).alias("n"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved")
    ).collect()[0]
    top = spark.createDataFrame(
        [
            (
                root["conv_id"],
                0,
                None,
                root["n_convs"],
                first["n"],
                first["leaves"] if first["n"] else 1,
                first["saved"] or 0,
                root["ends"],
            )
        ],
        "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends string",
    )
    return linked.select(*OUT).unionByName(top)
