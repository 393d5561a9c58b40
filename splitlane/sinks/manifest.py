"""Event tables that last: batches published through a manifest and compacted under readers.

Each batch is written to a folder of its own. A manifest version lists the live
folders; it is a small Parquet folder below ``_manifest`` that counts once Spark has
finished it (``_SUCCESS``), so readers see a version whole or not at all. Publishing
takes the next version number; if another writer took it first, the work is read again
and retried. Compaction packs the folders of published batches into files of about
``TARGET_BYTES`` and publishes a version that lists the packed folder in their place.
Folders leave the disk only by ``vacuum``, once no kept version names them: a reader
that listed the folders of an older version still reads every event once.

A repeated batch replaces its own entry; a batch already packed is not taken again.
Object stores need a put-if-absent for the version folders to keep this promise.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import types as T

from splitlane.sinks.tables import by_app
from splitlane.sources.tables import _files, registry_versions, remove_folder

MANIFEST = "folder string, first_batch long, last_batch long, kind string"
TARGET_BYTES = 128 << 20
TRIES = 20


def versions(spark: SparkSession, root: str) -> list[int]:
    """Complete manifest versions, oldest first."""
    return registry_versions(spark, f"{root}/_manifest")


def entries(spark: SparkSession, root: str, version: int | None = None) -> list[Row]:
    """The live folders of a version (the newest if None): a few rows once compacted."""
    known = versions(spark, root)
    if not known:
        return []
    chosen = known[-1] if version is None else version
    return spark.read.schema(MANIFEST).parquet(f"{root}/_manifest/version={chosen}").collect()


def _publish(spark: SparkSession, root: str, change) -> int:
    """Write the next version: ``change`` turns the newest entries into the new ones."""
    for _ in range(TRIES):
        known = versions(spark, root)
        number = (known[-1] if known else 0) + 1
        rows = [tuple(r) for r in change(entries(spark, root))]
        try:
            spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("errorifexists").parquet(
                f"{root}/_manifest/version={number}"
            )
            return number
        except Exception as clash:  # another writer took the number
            if "already exists" not in str(clash).lower():
                raise
    raise RuntimeError(f"no manifest version could be written at {root}")


def publish_batch(rows: DataFrame, root: str, batch_id: int) -> int | None:
    """Write one batch and make it live; returns the version, or None for a batch already packed."""
    spark = rows.sparkSession
    if any(e.kind == "packed" and e.first_batch <= batch_id <= e.last_batch for e in entries(spark, root)):
        return None
    folder = f"{root}/data/batch={batch_id}-{uuid.uuid4().hex}"
    by_app(rows).write.mode("errorifexists").parquet(folder)

    def change(live: list[Row]) -> list:
        kept = [e for e in live if not (e.kind == "batch" and e.first_batch == batch_id)]
        return [*kept, (folder, batch_id, batch_id, "batch")]

    return _publish(spark, root, change)


def read_events(spark: SparkSession, root: str, schema: T.StructType, version: int | None = None) -> DataFrame:
    """The events of the folders a version lists, read with ``schema``."""
    folders = [e.folder for e in entries(spark, root, version)]
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*folders)


def _bytes(spark: SparkSession, folders: list[str]) -> int:
    fs, jvm = _files(spark, folders[0])
    return sum(fs.getContentSummary(jvm.org.apache.hadoop.fs.Path(f)).getLength() for f in folders)


def compact(spark: SparkSession, root: str, schema: T.StructType, target_bytes: int = TARGET_BYTES) -> int | None:
    """Pack the live batch folders into files of about ``target_bytes``; returns the version."""
    batches = [e for e in entries(spark, root) if e.kind == "batch"]
    if len(batches) < 2:
        return None
    folders = [e.folder for e in batches]
    files = max(1, math.ceil(_bytes(spark, folders) / target_bytes))
    first, last = min(e.first_batch for e in batches), max(e.last_batch for e in batches)
    packed = f"{root}/data/packed={first}-{last}-{uuid.uuid4().hex}"
    rows = spark.read.schema(schema).parquet(*folders)
    rows.repartitionByRange(files, "app_id", "event_id").sortWithinPartitions("app_id", "event_id").write.mode(
        "errorifexists"
    ).parquet(packed)
    gone = set(folders)

    def change(live: list[Row]) -> list:
        # Batches published meanwhile stay; a repeat of a packed batch is dropped with the rest.
        kept = [e for e in live if e.folder not in gone and not (e.kind == "batch" and first <= e.first_batch <= last)]
        return [*kept, (packed, first, last, "packed")]

    return _publish(spark, root, change)


def vacuum(spark: SparkSession, root: str, keep: int = 2) -> list[str]:
    """Remove folders and versions that none of the newest ``keep`` versions lists."""
    known = versions(spark, root)
    if len(known) <= keep:
        return []
    wanted = {e.folder for v in known[-keep:] for e in entries(spark, root, v)}
    fs, jvm = _files(spark, root)
    found = fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{root}/data/*")) or []
    removed = []
    for status in found:
        path = status.getPath().toString()
        if not any(path.rstrip("/").endswith(w.split(":", 1)[-1].rstrip("/")) for w in wanted):
            remove_folder(spark, path)
            removed.append(path)
    for v in known[:-keep]:
        remove_folder(spark, f"{root}/_manifest/version={v}")
    return removed
