"""Event counts, app status and retrain eligibility."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from splitlane.operators.lookup import lookup_join
from splitlane.schema import FINISH, MIN_FINISHES, MIN_STARTS, NO_DATA, PREDICTING, START


def count_events(events: DataFrame, *by: str) -> DataFrame:
    return events.groupBy(*(by or ("app_id",))).agg(F.count(F.lit(1)).alias("n_events"))


def _type_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("app_id").agg(
        F.count_if(F.col("etype") == START).alias("n_start"),
        F.count_if(F.col("etype") == FINISH).alias("n_finish"),
    )


def _with_counts(registry: DataFrame, counts: DataFrame) -> DataFrame:
    zero = F.lit(0).cast("bigint")
    return (
        registry.join(counts, "app_id", "left")
        .withColumn("n_start", F.coalesce("n_start", zero))
        .withColumn("n_finish", F.coalesce("n_finish", zero))
    )


def app_status(events: DataFrame, registry: DataFrame, since: int | Column = 0) -> DataFrame:
    """Run state and raw event counts strictly after ``since``, for every app."""
    counts = _type_counts(events.where(F.col("ts_ms") > since))
    apps = registry.select("app_id", "run_state", "predicting_from")
    return _with_counts(apps, counts)


def retrain_epoch() -> Column:
    """Epoch whose events decide on retraining; null for states that never retrain."""
    return F.when(F.col("run_state") == PREDICTING, F.col("predicting_from")).when(
        F.col("run_state") == NO_DATA, F.lit(0).cast("bigint")
    )


def retrain_eligible(
    events: DataFrame,
    registry: DataFrame,
    min_starts: int = MIN_STARTS,
    min_finishes: int = MIN_FINISHES,
) -> DataFrame:
    """Apps with enough starts and finishes since their last training."""
    apps = registry.select("app_id", "run_state", retrain_epoch().alias("epoch")).where(
        F.col("epoch").isNotNull()
    )
    fresh = lookup_join(events, apps.select("app_id", "epoch"), "app_id", "inner").where(
        F.col("ts_ms") > F.col("epoch")
    )
    return _with_counts(apps, _type_counts(fresh)).where(
        (F.col("n_finish") >= min_finishes) & (F.col("n_start") >= min_starts)
    )
