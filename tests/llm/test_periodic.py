"""Periodic runs against a brute-force search of every lag."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from splitlane.llm.periodic import find_runs, periodic_runs, shortest
from splitlane.llm.queries import op11_periodic_runs


def brute_runs(h):
    """Every run, by trying every lag at every place."""
    h = np.asarray(h)
    n, out = len(h), set()
    for q in range(1, n // 4 + 1):
        equal = np.concatenate(([False], h[:-q] == h[q:], [False]))
        steps = np.diff(equal.astype(np.int8))
        for s, e in zip(np.flatnonzero(steps == 1), np.flatnonzero(steps == -1)):
            length = e - s + q
            part = h[s : s + length]
            smaller = any(q % d == 0 and np.array_equal(part[:-d], part[d:]) for d in range(1, q))
            if length >= shortest(q) and not smaller:
                out.add((int(s), int(length), q))
    return sorted(out)


def planted(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    if doc_id is None:
        return words
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n > 0:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    return words


def expected(doc_id, text):
    words = planted(doc_id, text)
    ids = {}
    runs = brute_runs([ids.setdefault(w, len(ids)) for w in words])
    gone = set()
    for s, length, q in runs:
        gone.update(range(s + q, s + length))
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    start, length, period = best if best else (None, None, None)
    return (
        doc_id,
        len(runs),
        start,
        length,
        period,
        None if best is None else (1000 * length) // period,
        hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(),
        hashlib.sha256(kept).hexdigest(),
    )


@pytest.mark.parametrize("seed", range(4))
def test_every_run_is_found(seed):
    rnd = random.Random(seed)
    for _ in range(150):
        n = rnd.randint(0, 400)
        h = [rnd.randrange(rnd.choice([2, 3, 7, 100])) for _ in range(n)]
        for _ in range(rnd.randint(0, 3)):
            if n > 10:
                p, a = rnd.randint(1, n // 4), rnd.randrange(n)
                b = rnd.randint(a, n)
                h[a:b] = [h[a + (i - a) % p] for i in range(a, b)]
        assert find_runs(np.array(h, np.uint64) * np.uint64(0x9E3779B97F4A7C15)) == brute_runs(h)


def test_long_periods_and_long_texts():
    rnd = np.random.default_rng(3)
    unit = rnd.integers(0, 1 << 40, 700).astype(np.uint64)
    h = np.concatenate([rnd.integers(0, 1 << 40, 500).astype(np.uint64), np.tile(unit, 5)[:3300], unit[:3]])
    assert find_runs(h) == [(500, 3300, 700)]
    assert find_runs(np.zeros(300_000, np.uint64)) == [(0, 300_000, 1)]


def test_query_equals_brute_force(spark, small):
    rows = [(r.doc_id, r.text) for r in small.select("doc_id", "text").collect()]
    got = sorted(tuple(r) for r in op11_periodic_runs(spark, "/root/testdata/sf0.001").collect())
    assert got == sorted(expected(d, t) for d, t in rows)
    assert any(r[1] > 0 for r in got)


def test_awkward_rows(spark, awkward, clashing, nothing):
    got = {
        r.doc_id: r
        for r in periodic_runs(awkward).select("doc_id", "text", "runs", "collapsed").collect()
        if r.doc_id in (1, 2, 3, 9, 10)
    }
    assert got[1].runs == [] and got[1].collapsed == ""
    assert got[2].runs == [] and got[3].collapsed == ""
    assert [tuple(r) for r in got[9].runs] == [(0, 180, 3)]
    assert got[9].collapsed == "the same line"
    assert got[10].runs == [] and got[10].collapsed == got[10].text
    assert periodic_runs(awkward).count() == awkward.count()
    mine = periodic_runs(clashing.withColumn("runs", clashing["text"]).withColumn("collapsed", clashing["text"]))
    assert mine.columns.count("runs") == 1 and mine.count() == awkward.count()
    assert periodic_runs(nothing).count() == 0
