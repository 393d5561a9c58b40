"""Choosing variations: random assignment, score expansion and the best of the scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from splitlane.functions.scores import (
    best_position,
    event_kind,
    jitter,
    random_position,
    visitor_key,
)


def expand_variations(configured: DataFrame) -> DataFrame:
    """One row per visitor and variation of its app."""
    return configured.select("*", F.posexplode("variations").alias("variation_idx", "option"))


def score_jitter(df: DataFrame, *keys: str, salt: str = "jitter") -> DataFrame:
    """Add the exploration offset to ``score``, drawn by ``keys`` and the variation."""
    offset = jitter(*[F.col(k) for k in keys], F.col("variation_idx"), F.lit(salt))
    return df.withColumn("score", F.col("score") + offset)


def argmax_variation(scored: DataFrame, *keys: str) -> DataFrame:
    """The best-scored variation per visitor; equal scores go to the lower position.

    An aggregate, so that the rows a visitor was expanded into are combined
    where they were made.
    """
    best = F.max(F.struct(F.col("score"), (-F.col("variation_idx")).alias("neg"))).alias("best")
    return (
        scored.groupBy(*keys)
        .agg(best)
        .select(*keys, (-F.col("best.neg")).alias("variation_idx"), F.col("best.score").alias("score"))
    )


def chosen(position: Column, modelled: Column) -> list[Column]:
    """Variation, its value, the kind and the score-free outcome at a config position."""
    option = F.get(F.col("variations"), position)
    return [
        option["id"].alias("variation"),
        option["value"].alias("value"),
        event_kind(modelled).alias("kind"),
    ]


def random_assign(configured: DataFrame, salt: str = "assign") -> DataFrame:
    """A uniform variation per visitor, the same one for all requests of a session."""
    who = visitor_key(F.col("session"), F.col("event_id"))
    position = random_position(F.size("variations"), F.col("app_id"), who, F.lit(salt))
    return configured.withColumn("variation_idx", position).select(
        *configured.columns, "variation_idx", *chosen(F.col("variation_idx"), F.lit(False))
    )


def pick_best(scored: DataFrame, salt: str = "jitter") -> DataFrame:
    """The best variation of an in-row ``scores`` array, with jitter, without a shuffle."""
    nudged = F.transform(
        F.col("scores"),
        lambda s, i: s + jitter(F.col("app_id"), F.col("event_id"), i, F.lit(salt)),
    )
    columns = [c for c in scored.columns if c != "scores"]
    return (
        scored.withColumn("scores", nudged)
        .withColumn("variation_idx", best_position(F.col("scores")))
        .select(
            *columns,
            "variation_idx",
            *chosen(F.col("variation_idx"), F.lit(True)),
        )
    )
