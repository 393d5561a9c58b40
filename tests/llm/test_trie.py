"""The conversation trie against a plain-Python trie."""

import hashlib
import zlib

import pytest

from splitlane.llm.queries import op13_conversation_trie
from splitlane.llm.trie import conversation_trie


def plain_trie(convs):
    """Nodes of the trie of {conv_id: [(role, text), ...]} as the query gives them."""
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children = {p: [] for p in members}
    for p in members:
        if p:
            children[p[:-1]].append(p)

    def subtree(p):
        out = [p]
        for q in children[p]:
            out += subtree(q)
        return out

    rows = []
    for p, ms in members.items():
        sub = subtree(p)
        ends = sorted(c for c in ms if len(convs[c]) == len(p))
        rows.append(
            (
                min(ms),
                len(p),
                min(members[p[:-1]]) if p else None,
                len(ms),
                len(children[p]),
                sum(1 for q in sub if not children[q]),
                sum((len(members[q]) - 1) * len(q[-1][1]) for q in sub if q),
                hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
            )
        )
    return sorted(rows, key=str)


def rebuilt(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def test_query_equals_plain_trie(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    rows = [tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]
    got = sorted((tuple(r) for r in op13_conversation_trie(spark, "/root/testdata/sf0.001").collect()), key=str)
    assert got == plain_trie(rebuilt(rows))


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_edges_of_partitions(spark, parts):
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    rows = []
    for c in range(60):
        first = [("user", "hello"), ("bot", "hi")] if c % 2 else [("user", "hey")]
        rest = [("user", f"q{c % 5}"), ("bot", "é" * (c % 3))][: c % 3]
        for t, (r, x) in enumerate(first + rest + ([("user", "same")] * (c % 4))):
            rows.append((c, t, r, x))
    rows += [(100, None, None, None), (101, 5, "user", None), (101, 5, None, "hey"), (None, 1, "user", "lost")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    extra = spark.createDataFrame([(7,), (500,)], "conv_id long")
    got = sorted((tuple(r[:-1]) + (hashlib.sha256(r[-1].encode()).hexdigest(),) for r in conversation_trie(table, extra).collect()), key=str)
    convs = {}
    for c, t, r, x in sorted(rows, key=lambda v: (str(v[0]), v[1] is not None, v[1] or 0, v[2] or "", v[3] or "")):
        if c is not None:
            convs.setdefault(c, []).append((r or "", x or ""))
    convs[500] = []
    assert got == plain_trie(convs)
    spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_awkward_tables(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string, extra string")
    assert conversation_trie(empty).count() == 0
    one = spark.createDataFrame([(1, 1, "user", "x" * 100_000, "mine")], "conv_id long, turn long, role string, text string, depth string")
    got = sorted(tuple(r) for r in conversation_trie(one).select("depth", "n_convs", "n_leaves", "saved_tokens").collect())
    assert got == [(0, 1, 1, 0), (1, 1, 1, 0)]
