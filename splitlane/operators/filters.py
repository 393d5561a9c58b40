"""Row filters and unions of event tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from splitlane.functions.scores import variation_position
from splitlane.schema import FINISH, START


def filter_app(df: DataFrame, app_id: str) -> DataFrame:
    return df.where(F.col("app_id") == app_id)


def filter_since(df: DataFrame, epoch_ms: int | Column) -> DataFrame:
    """Rows strictly after an epoch."""
    return df.where(F.col("ts_ms") > epoch_ms)


def filter_equal(df: DataFrame, **selector: object) -> DataFrame:
    """Rows equal to every given value."""
    for name, value in selector.items():
        df = df.where(F.col(name) == F.lit(value))
    return df


def starts_of(events: DataFrame) -> DataFrame:
    return events.where(F.col("etype") == START)


def finishes_of(events: DataFrame) -> DataFrame:
    return events.where(F.col("etype") == FINISH)


def split_by_type(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    return starts_of(events), finishes_of(events)


def filter_known_variation(df: DataFrame) -> DataFrame:
    """Rows whose variation is in their app's config (columns of ``config_join``)."""
    return df.where(variation_position(F.col("variations"), F.col("variation")).isNotNull())


def union_events(starts: DataFrame, finishes: DataFrame) -> DataFrame:
    """Starts and finishes as one table; columns a finish lacks are null."""
    return starts.withColumn("etype", F.lit(START)).unionByName(
        finishes.withColumn("etype", F.lit(FINISH)), allowMissingColumns=True
    )


def union_sources(parts: list[DataFrame]) -> DataFrame:
    """Several sources of one schema as one dataset; each keeps its own partitions."""
    return reduce(DataFrame.unionByName, parts)


def stamp_server_time(df: DataFrame, server_ts: int | Column) -> DataFrame:
    """Replace the client's timestamp; it is kept as ``client_ts`` for enrichment."""
    stamp = F.lit(server_ts) if isinstance(server_ts, int) else server_ts
    return df.withColumn("client_ts", F.col("ts_ms")).withColumn("ts_ms", stamp.cast("bigint"))
