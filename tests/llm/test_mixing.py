"""Source mixing: targets by hand, thresholds against a sort, the query against its SQL."""

import re

from compare import connect, difference
from conftest import SMALL, awkward_rows
from pyspark.sql import functions as F

from splitlane.llm import oracles, queries
from splitlane.llm.mixing import mix_sources, mixing_plan, sized, source_targets
from splitlane.llm.thresholds import WHOLE, budget_cuts, hash60


def mixed(docs):
    rows = sized(docs)
    return mix_sources(rows, mixing_plan(rows.select("doc_id", "source", "size")))


def test_targets_stop_at_three_times_the_size_and_are_shared_again(spark):
    sizes = spark.createDataFrame(
        [("=a", "a", 10), ("=b", "b", 1000), ("=c", "c", 2000), ("-", None, 4)], "grp string, source string, source_size long"
    )
    got = {r.grp: r.target for r in source_targets(sizes).collect()}
    # a weighs 5 but is full at 30; null weighs 5 too (fourth of 5, 2, 1, 5) and is full at 12.
    left = 3014 - 30 - 12
    assert got["=a"] == 30 and got["-"] == 12
    assert abs(got["=b"] - left * 2 / 3) < 1e-9 and abs(got["=c"] - left / 3) < 1e-9


def test_cuts_equal_a_sort(spark):
    rows = spark.range(3000).select(
        (F.col("id") % 3).alias("grp"), hash60(F.col("id") % 2000).alias("hash"), (F.col("id") % 11).alias("size")
    )
    budgets = spark.createDataFrame([(0, 700), (1, 10**9), (2, 0)], "grp long, budget long")
    got = {r.grp: r.cut for r in budget_cuts(rows, budgets).collect()}
    assert got[1] == WHOLE
    for grp, budget in ((0, 700), (2, 0)):
        cells = {}
        for r in rows.filter(F.col("grp") == grp).collect():
            cells[r.hash] = cells.get(r.hash, 0) + r.size
        best, total = 0, 0
        for h in sorted(cells):
            if abs(total + cells[h] - budget) < abs(total - budget) or cells[h] == 0:
                best, total = h + 1, total + cells[h]
            else:
                break
        taken = sum(s for h, s in cells.items() if h < got[grp])
        assert taken == total


def test_awkward_rows(clashing):
    got = mixed(clashing).collect()
    assert len(got) == len(awkward_rows())
    sizes = {}
    for _, text, _, source, _ in awkward_rows():
        sizes[source] = sizes.get(source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    for r in got:
        assert r.source_size == sizes[r.source] and 0 <= r.copies <= 3 and r.target <= 3 * r.source_size
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) and r.grp == "mine grp"
    assert abs(sum({r.source: r.target for r in got}.values()) - sum(sizes.values())) < 1e-6


def test_no_documents_and_no_words(spark, nothing):
    assert mixed(nothing).count() == 0
    empty = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert [(r.size, r.target) for r in mixed(empty).collect()] == [(0, 0.0)] * 2


def test_query_equals_its_sql(spark, small):
    got = queries.QUERIES["op3_mix_sources"](spark, SMALL)
    assert difference(got, connect(SMALL), oracles.ORACLES["op3_mix_sources"]) is None
