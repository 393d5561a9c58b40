"""Mixing sources to target weights, by DataFrame functions only.

Sizes are summed by source; targets come from the sums. A source is taken in whole
copies as often as its target holds it, and the rest of the target is met by the
documents whose hash lies below a threshold (see thresholds.py).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from splitlane.llm.tables import WORD
from splitlane.llm.thresholds import budget_cuts, hash60
from splitlane.operators.lookup import fits_broadcast, lookup_join
from splitlane.session import settle

WEIGHTS = (5, 2, 1)
MOST = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _group(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source), F.lit("-"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """grp, source_size, target, from one row (grp, source, source_size) per source.

    Sources in code point order, null last, weigh ``weights``, repeating. They share the
    total by weight; a target stops at ``most`` times its source's size, and the excess is
    shared again among the others. With sources in order of size over weight, a level
    tried after each full one is highest where the sharing ends. One row per source
    passes through one task.
    """
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]),
        ((F.row_number().over(ordered) - 1) % len(weights) + 1).cast("int"),
    )
    everything = Window.partitionBy()
    fullness = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = fullness.rowsBetween(Window.unboundedPreceding, -1)
    rest = fullness.rowsBetween(0, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    return (
        sizes.withColumn("weight", weight)
        .withColumn("cap", F.col("source_size") * float(most))
        .withColumn("level", left / F.sum("weight").over(rest))
        .withColumn("target", F.least("cap", F.max("level").over(everything) * F.col("weight")))
        .select("grp", "source_size", "target")
    )


def sized(docs: DataFrame) -> DataFrame:
    """``docs`` with ``size``, the number of words; null text has none."""
    return docs.withColumn("size", word_count(F.col("text")))


def mixing_plan(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """grp, source_size, target, whole, cut: how much to take of each source.

    ``rows`` holds doc_id, source and size. Every document is taken ``whole`` times, and
    once more if the hash of its id lies below ``cut``.
    """
    table = settle(
        rows.select(_group(F.col("source")).alias("grp"), "source", hash60(F.col("doc_id")).alias("hash"), "size"),
        "sized",
    )
    sizes = table.groupBy("grp", "source").agg(F.sum("size").alias("source_size"))
    targets = settle(
        source_targets(sizes, weights, most)
        .withColumn("whole", F.coalesce(F.floor(F.col("target") / F.nullif("source_size", F.lit(0))), F.lit(0)))
        .withColumn("budget", F.floor("target") - F.col("whole") * F.col("source_size")),
        "targets",
    )
    cuts = budget_cuts(table.select("grp", "hash", "size"), targets.select("grp", "budget"))
    return settle(targets.drop("budget").join(cuts, "grp"), "mix")


def mix_sources(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """``docs`` (with doc_id, source, size) with source_size, target and copies.

    Null sources are one source, empty texts are taken with size 0, rows sharing a doc_id
    are taken together, and rows without one share the hash of the empty id. Nothing is
    sorted; the same documents are taken again when a task is repeated.
    Columns named like the three results are replaced.
    """
    plain = docs.drop("source_size", "target", "copies")
    lookup = plan.withColumnsRenamed({c: f"_mix_{c}" for c in plan.columns})
    keyed = plain.withColumns({"_mix_grp": _group(F.col("source")), "_mix_hash": hash60(F.col("doc_id"))})
    joined = lookup_join(keyed, lookup, "_mix_grp", "left", small=fits_broadcast(plan))
    copies = F.col("_mix_whole") + (F.col("_mix_hash") < F.col("_mix_cut")).cast("long")
    return joined.select(
        *plain.columns, F.col("_mix_source_size").alias("source_size"), F.col("_mix_target").alias("target"), copies.alias("copies")
    )
