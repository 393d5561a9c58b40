"""Sharding laws, checked row by row in plain Python."""

import itertools
import zlib

import pytest

from splitlane.llm.queries import op12_sharding
from splitlane.llm.sharding import difference, shard_documents


def test_differencing_combines_largest_spreads():
    # The classic two-way example: differencing 8 7 6 5 4 leaves 2 (8 and 7 are set apart first).
    parts = [([v, 0], [i, -1]) for i, v in enumerate([8, 7, 6, 5, 4])]
    got = difference(parts, 2)
    assert sorted(s for s, _ in got) == [14, 16]
    assert all(sum([8, 7, 6, 5, 4][i] for i in m) == s for s, m in got)
    assert [0, 1] not in [sorted(m)[:2] for _, m in got]
    for k in (2, 3):
        values = [13, 11, 9, 9, 7, 5, 3, 2, 2, 1]
        got = difference([([v] + [0] * (k - 1), [i] + [-1] * (k - 1)) for i, v in enumerate(values)], k)
        assert sorted(i for _, m in got for i in m) == list(range(len(values)))
        best = min(
            max(sum(v for v, s in zip(values, cut) if s == j) for j in range(k)) - min(sum(v for v, s in zip(values, cut) if s == j) for j in range(k))
            for cut in itertools.product(range(k), repeat=len(values))
        )
        assert max(s for s, _ in got) - min(s for s, _ in got) <= best + max(values) // 2
    assert difference([], 3) == []


def check_plan(rows, plan, shards, law):
    texts = {}
    for d, t in rows:
        texts.setdefault(d, set()).add(t)
    by_shard = {}
    for r in plan:
        assert r.law == law and 0 <= r.shard < shards
        body = next(iter(texts[r.doc_id])) if len(texts[r.doc_id]) == 1 else None
        if body is not None or r.doc_id is None:
            body = body or ""
            assert r.size == len(body.encode()) + 16 and r.text_crc32 == zlib.crc32(body.encode())
        by_shard.setdefault(r.shard, []).append(r)
    for got in by_shard.values():
        assert sorted(r.slot for r in got) == list(range(len(got)))
        order = sorted(got, key=lambda r: (r.doc_id is not None, r.doc_id, r.text_crc32, r.size))
        assert [r.slot for r in order] == list(range(len(got)))
    return by_shard


def test_bytes_law_on_the_table(spark, small):
    rows = [(r.doc_id, r.text) for r in small.select("doc_id", "text").collect()]
    plan = op12_sharding(spark, "/root/testdata/sf0.001").collect()
    assert len(plan) == len(rows)
    by_shard = check_plan(rows, plan, 40, "bytes")
    where = {}
    for d, t in rows:
        where.setdefault(t or "", set())
    shard_of = {r.doc_id: r.shard for r in plan}
    for d, t in rows:
        where[t or ""].add(shard_of[d])
    assert all(len(s) == 1 for s in where.values())
    sums = [sum(r.size for r in by_shard.get(s, [])) for s in range(40)]
    biggest = max(sum(len((t or "").encode()) + 16 for d, t in rows if (t or "") == x) for x in where)
    assert max(sums) - min(sums) <= biggest


@pytest.mark.parametrize("law", ["rows", "key", "bytes"])
def test_awkward_rows(spark, awkward, clashing, nothing, law):
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    plan = shard_documents(awkward, 5, law).collect()
    assert len(plan) == len(rows)
    by_shard = check_plan(rows, plan, 5, law)
    counts = [len(by_shard.get(s, [])) for s in range(5)]
    if law == "rows":
        assert max(counts) - min(counts) <= 1
    if law == "key":
        assert all(r.grown_shard in (r.shard, 5) for r in plan)
        again = {(r.doc_id, r.slot): r.shard for r in shard_documents(awkward, 5, law).collect()}
        assert again == {(r.doc_id, r.slot): r.shard for r in plan}
    else:
        assert all(r.grown_shard is None for r in plan)
    mine = shard_documents(clashing.withColumn("k1", clashing["text"]).withColumn("_part", clashing["text"]), 5, law)
    assert mine.count() == len(rows) and "k1" in mine.columns and mine.columns.count("shard") == 1
    assert shard_documents(nothing, 5, law).count() == 0
