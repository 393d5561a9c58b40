"""Writing event tables, registry versions, CSV samples and training metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splitlane.functions.identity import project_identity
from splitlane.schema import FINISH_EVENTS, REGISTRY, START_EVENTS, TRAIN_METRICS
from splitlane.sources.tables import registry_versions

# Places that one task's rows of an app are dealt to; small ones are merged again.
PLACES = 8


def append_starts(starts: DataFrame, path: str) -> None:
    _append(starts.select(*START_EVENTS.names), path)


def append_finishes(finishes: DataFrame, path: str) -> None:
    _append(finishes.select(*FINISH_EVENTS.names), path)


def _append(rows: DataFrame, path: str) -> None:
    by_app(rows).write.mode("append").partitionBy("app_id").parquet(path)


def by_app(rows: DataFrame, folders: tuple[str, ...] = ("app_id",)) -> DataFrame:
    """Rows of an app brought together, large apps split by size: few files, none oversized.

    Ordered by id inside ``folders``, the columns the rows are then partitioned by: the
    order such a write needs anyway, so rows are held and sorted once, and readers of the
    latest rows can skip row groups. A large app can be split no finer than what one task
    sends of it to one place, so its rows go to PLACES places.
    """
    order = [*folders, *(c for c in ("event_id",) if c in rows.columns)]
    placed = rows.withColumn("_place", F.pmod(F.xxhash64(*order[len(folders) :], "app_id"), F.lit(PLACES)))
    return placed.hint("rebalance", "app_id", "_place").sortWithinPartitions(*order).drop("_place")


def write_registry(registry: DataFrame, path: str) -> int:
    """Write a new registry version; readers see it once it is complete."""
    known = registry_versions(registry.sparkSession, path)
    version = (known[-1] if known else 0) + 1
    registry.select(*REGISTRY.names).write.mode("overwrite").parquet(f"{path}/version={version}")
    return version


def sample_rows(sample: DataFrame, names: list[str]) -> DataFrame:
    """Rows of a sample dump: descriptor values, variation, result."""
    return sample.select(
        *project_identity(F.col("identity"), names),
        F.col("variation"),
        F.when(F.col("goal"), F.lit("true")).otherwise(F.lit("false")).alias("result"),
    )


def dump_sample(sample: DataFrame, names: list[str], path: str) -> str:
    """Write one app's labelled sample as CSV files with a header; unknown variations stay in."""
    (
        sample_rows(sample, names)
        .write.mode("errorifexists")
        .option("header", True)
        .option("emptyValue", "")
        .csv(path)
    )
    return path


def append_metrics(report: DataFrame, path: str) -> None:
    report.select(*TRAIN_METRICS.names).write.mode("append").parquet(path)
