"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"

_local_roots: dict[str, str] = {}


def local_session(cpus: int | str = 8, name: str = "splitlane", **settings: str) -> SparkSession:
    """A session for tests and the benchmark; a cluster brings its own settings."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    for key, value in settings.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by the cluster; a local folder only under a local master."""
    sc = spark.sparkContext
    root = sc.getConf().get(CHECKPOINT_SETTING) or spark.conf.get(CHECKPOINT_SETTING, None)
    if root:
        return root
    if not sc.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_SETTING} to a folder every executor can reach")
    if sc.applicationId not in _local_roots:
        _local_roots[sc.applicationId] = tempfile.mkdtemp(prefix="splitlane-")
    return _local_roots[sc.applicationId]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path below the scratch folder, in the folder of this application.

    The application's folder may be removed once the application has ended.
    """
    own = f"{scratch_root(spark).rstrip('/')}/splitlane/{spark.sparkContext.applicationId}"
    return f"{own}/{label}-{uuid.uuid4().hex}"


def settle(df: DataFrame, label: str = "table", partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` to the scratch folder and read it back.

    The result has no lineage to recompute when executors are lost, keeps column
    pruning, and carries a real file size for the join planner.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
