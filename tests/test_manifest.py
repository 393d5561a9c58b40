"""Batches published through a manifest, packed while a reader reads, each event seen once."""

import glob

from pyspark.sql import types as T

from splitlane.session import scratch_path
from splitlane.sinks import manifest

SCHEMA = T.StructType(
    [T.StructField("event_id", T.LongType()), T.StructField("app_id", T.StringType()), T.StructField("ts_ms", T.LongType())]
)


def batch(spark, number, size=5):
    return spark.createDataFrame([(number * 100 + i, f"app {i % 3}", number) for i in range(size)], SCHEMA)


def test_batches_compaction_and_readers(spark):
    root = scratch_path(spark, "events")
    assert manifest.read_events(spark, root, SCHEMA).count() == 0
    for number in range(200):
        manifest.publish_batch(batch(spark, number), root, number)
    manifest.publish_batch(batch(spark, 7), root, 7)
    assert len(manifest.entries(spark, root)) == 200
    before = manifest.read_events(spark, root, SCHEMA)
    size = sum(len(open(f, "rb").read()) for f in glob.glob(f"{root}/data/batch=*/*.parquet"))
    assert manifest.compact(spark, root, SCHEMA, target_bytes=size // 4) is not None
    live = manifest.entries(spark, root)
    assert [(e.kind, e.first_batch, e.last_batch) for e in live] == [("packed", 0, 199)]
    assert len(glob.glob(f"{live[0].folder}/*.parquet")) <= 4
    for reader in (before, manifest.read_events(spark, root, SCHEMA)):
        ids = [r.event_id for r in reader.collect()]
        assert len(ids) == len(set(ids)) == 1000
    assert manifest.publish_batch(batch(spark, 7), root, 7) is None
    manifest.publish_batch(batch(spark, 300), root, 300)
    manifest.publish_batch(batch(spark, 300), root, 300)
    removed = manifest.vacuum(spark, root, keep=1)
    assert len(removed) >= 200
    ids = [r.event_id for r in manifest.read_events(spark, root, SCHEMA).collect()]
    assert len(ids) == len(set(ids)) == 1005
    assert manifest.compact(spark, root, SCHEMA) is None
