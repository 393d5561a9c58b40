"""Labelled session samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splitlane.operators.latest import PAYLOAD, SESSION_KEYS, latest_start
from splitlane.schema import FINISH, START


def drop_blank_sessions(events: DataFrame) -> DataFrame:
    """Leave out events that came without a session (they would all pair up as one)."""
    return events.where(F.col("session") != "")


def session_sample(
    events: DataFrame, kinds: tuple[str, ...] | None = None, payload: tuple[str, ...] = PAYLOAD
) -> DataFrame:
    """One row per session with a start: its latest start and whether it finished.

    One grouping over starts and finishes together. A finish counts wherever it
    lies in time. ``kinds`` limits the starts that are considered.
    """
    columns = [c for c in payload if c in events.columns]
    is_start = F.col("etype") == START
    if kinds:
        is_start = is_start & F.col("kind").isin(*kinds)
    return (
        events.groupBy(*SESSION_KEYS)
        .agg(
            F.max_by(F.struct(*columns), F.when(is_start, F.col("event_id"))).alias("latest"),
            F.count_if(is_start).alias("n_start"),
            F.bool_or(F.col("etype") == FINISH).alias("goal"),
        )
        .where(F.col("n_start") > 0)
        .select("app_id", "session", "latest.*", "n_start", "goal")
    )


def session_pair_join(starts: DataFrame, finishes: DataFrame) -> DataFrame:
    """The same pairing as a join.

    Both sides are reduced to one row per session before they meet, so the join
    has no hot key and reuses the partitioning of the two aggregates.
    """
    finished = finishes.select(*SESSION_KEYS).distinct().withColumn("_finished", F.lit(True))
    return (
        latest_start(starts)
        .join(finished, list(SESSION_KEYS), "left")
        .withColumn("goal", F.coalesce(F.col("_finished"), F.lit(False)))
        .drop("_finished")
    )
