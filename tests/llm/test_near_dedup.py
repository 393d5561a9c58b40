"""Near-duplicate classes against weighted similarities of all pairs."""

import numpy as np
import pyarrow as pa
import pytest
from conftest import awkward_rows, words
from pyspark.sql import functions as F

from splitlane.llm import arrays as A
from splitlane.llm import near_dedup as near_dedup_module
from splitlane.llm.components import connected_components
from splitlane.llm.near_dedup import _cell, inverse_frequencies, near_dedup, shingles, text_ids


def brute(rows, idf, threshold=0.8):
    """The class of each row: smallest id among rows linked directly or through others."""
    sets = []
    for _, text in rows:
        _, h, n = shingles(*A.text_buffers(pa.array([text or ""])))
        sets.append(dict(zip(h.tolist(), (n * idf[_cell(h)]).tolist())))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    near = set()
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b:
                common = sum(min(w, b[h]) for h, w in a.items() if h in b)
                likeness = common / (sum(a.values()) + sum(b.values()) - common)
                if likeness >= threshold:
                    root[find(i)] = find(j)
                    near.add((i, j))
    ids = [i for i, _ in rows]
    members = {}
    for k in range(len(rows)):
        members.setdefault(find(k), []).append(ids[k])
    least = {k: min((x for x in v if x is not None), default=None) for k, v in members.items()}
    return [least[find(k)] if sets[k] else ids[k] for k in range(len(rows))]


def classes(docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    expected = brute(rows, inverse_frequencies(text_ids(docs)))
    got = near_dedup(docs).select("doc_id", "text", "class_id").collect()
    order = lambda x: str((x[0], x[1], x[2]))
    return sorted(map(tuple, got), key=order), sorted(((*r, c) for r, c in zip(rows, expected)), key=order)


def test_awkward_rows(clashing):
    got, expected = classes(clashing)
    assert got == expected


def test_table(small):
    got, expected = classes(small)
    assert got == expected


def test_one_row_of_each_class_is_first(clashing):
    rows = near_dedup(clashing).collect()
    firsts = [r for r in rows if r.is_first]
    assert {r.class_id for r in firsts if r.text} == {r.class_id for r in rows if r.text}
    assert all(r.tid == "mine tid" for r in rows) and len(rows) == len(awkward_rows())


def test_a_large_group_of_near_copies(spark):
    rows = [(i, words(0, 200) + f" end{i}") for i in range(300)] + [(1000, words(5000, 200)), (1001, words(0, 60))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in near_dedup(docs).collect()}
    assert {got[i] for i in range(300)} == {0} and got[1000] == 1000 and got[1001] == 1001


def test_no_documents(nothing):
    assert near_dedup(nothing).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = np.random.default_rng(seed)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 60, (40, 2))] + [(100 + i, 101 + i) for i in range(30)]
    got = connected_components(spark.createDataFrame(pairs, "a long, b long").select("a", "b"))
    root = {x: x for p in pairs for x in p}
    for _ in range(len(pairs)):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    expected = {x: r for x, r in root.items() if any(x in p and p[0] != p[1] for p in pairs)}
    assert {r.node: r.root for r in got.collect()} == expected
    assert got.select(F.count_distinct("node")).first()[0] == got.count()


@pytest.mark.parametrize("local", [2, 256])
def test_unlike_texts_that_share_bands(spark, monkeypatch, local):
    """Texts of one heavy common shingle and words of their own, some of them near-copies."""
    monkeypatch.setattr(near_dedup_module, "LOCAL", local)
    rows = [(i, "ha " * 40 + words(100 * (i // 2), 12) + (" z" if i % 2 else "")) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got, expected = classes(docs)
    assert got == expected


@pytest.mark.parametrize("local", [16, 512])
def test_no_pair_of_a_group_goes_unmeasured(spark, monkeypatch, local):
    """A drifting family in one band group: only neighbours are alike, and every link counts."""
    monkeypatch.setattr(near_dedup_module, "LOCAL", local)
    monkeypatch.setattr(near_dedup_module, "band_keys", lambda text, shingle, weight, texts: np.zeros((texts, 16), np.uint64))
    rows = [(i, words(8 * i, 100)) for i in range(40)] + [(1000 + i, words(10000 * (i + 1), 100)) for i in range(4)]
    got, expected = classes(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got == expected and len({c for *_, c in got}) == 5


def test_a_family_of_a_third_of_the_rows(spark):
    """Pairs of a plain similarity of 0.82 are alike, however large their family is."""
    rows = [(i, words(0, 104) + " " + words(10000 + 100 * i, 11)) for i in range(20)]
    rows += [(100 + i, words(100000 * (i + 1), 115)) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in near_dedup(docs).collect()}
    assert all(got[i] == (0 if i < 20 else i) for i, _ in rows)
