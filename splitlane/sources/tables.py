"""Reading event tables, registry versions and request bodies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from splitlane.functions.bodies import (
    body_fault,
    finish_columns,
    parse_events,
    predict_columns,
    start_columns,
    start_fault,
)
from splitlane.operators.filters import filter_equal
from splitlane.schema import FINISH, FINISH_EVENTS, PREDICT, REGISTRY, REQUESTS, START, START_EVENTS


def _latest_first(df: DataFrame, limit: int | None) -> DataFrame:
    """With a limit, the newest rows (a distributed top-k)."""
    return df if limit is None else df.orderBy(F.col("event_id").desc()).limit(limit)


def scan_starts(
    spark: SparkSession, path: str, limit: int | None = None, **selector: object
) -> DataFrame:
    """Start events equal to a selector; ``app_id`` prunes folders, the rest is pushed down."""
    rows = spark.read.schema(START_EVENTS).parquet(path)
    return _latest_first(filter_equal(rows, **selector), limit)


def scan_finishes(
    spark: SparkSession, path: str, limit: int | None = None, **selector: object
) -> DataFrame:
    rows = spark.read.schema(FINISH_EVENTS).parquet(path)
    return _latest_first(filter_equal(rows, **selector), limit)


def scan_requests(spark: SparkSession, path: str) -> DataFrame:
    """Requests as JSON lines."""
    return spark.read.schema(REQUESTS).json(path)


def decode_starts(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Start events and, apart, the requests that are none, with the reason."""
    return _decode(requests, start_columns, start_fault)


def decode_predicts(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    return _decode(requests, predict_columns, body_fault)


def decode_finishes(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    return _decode(requests, finish_columns, body_fault)


def _decode(requests: DataFrame, columns, fault) -> tuple[DataFrame, DataFrame]:
    parsed = parse_events(requests).withColumn("fault", fault(F.col("event")))
    kept = [c for c in requests.columns if c != "body"]
    good = parsed.where(F.col("fault").isNull()).select(
        *kept, *[c.alias(name) for name, c in columns(F.col("event")).items()]
    )
    bad = parsed.where(F.col("fault").isNotNull()).select(*requests.columns, "fault")
    return good, bad


def scan_tolerant(requests: DataFrame) -> DataFrame:
    """Every request with its fault by the rules of its route; null when it decodes."""
    event, route = F.col("event"), F.col("route")
    fault = (
        F.when(route == START, start_fault(event))
        .when(route.isin(FINISH, PREDICT), body_fault(event))
        .otherwise(F.lit("unknown route"))
    )
    return parse_events(requests).withColumn("fault", fault).drop("event")


def remove_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder and what is in it, if it is there."""
    fs, jvm = _files(spark, path)
    fs.delete(jvm.org.apache.hadoop.fs.Path(path), True)


# --- registry versions ---------------------------------------------------------------------


def _files(spark: SparkSession, path: str):
    """Hadoop file system of a path: the same call for local disks and object stores."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm


def registry_versions(spark: SparkSession, path: str) -> list[int]:
    """Complete registry versions below a path, oldest first."""
    fs, jvm = _files(spark, path)
    hits = fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{path}/version=*/_SUCCESS"))
    names = [h.getPath().getParent().getName() for h in (hits or [])]
    return sorted(int(n.split("=")[1]) for n in names)


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """The newest complete registry version."""
    versions = registry_versions(spark, path)
    if not versions:
        raise FileNotFoundError(f"no registry at {path}")
    return spark.read.schema(REGISTRY).parquet(f"{path}/version={versions[-1]}")
