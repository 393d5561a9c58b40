"""Streams of requests and events.

Every sink writes one folder per micro-batch and overwrites it when the batch is
run again, so a batch repeated after a failure leaves its rows once.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from splitlane.operators.filters import stamp_server_time
from splitlane.operators.geo import PlaceIndex, place_index
from splitlane.operators.latest import SESSION_KEYS
from splitlane.operators.sessions import session_sample
from splitlane.operators.lookup import lookup_join
from splitlane.operators.registry import command_accepted
from splitlane.plans.predict import enrich_requests, predict_and_log, refused_requests
from splitlane.schema import FINISH, FINISH_EVENTS, PREDICT, REQUESTS, START, START_EVENTS
from splitlane.sinks.tables import by_app
from splitlane.sources.tables import (
    decode_finishes,
    decode_predicts,
    decode_starts,
    read_registry,
    remove_folder,
)

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keep_state_on_disk(spark: SparkSession) -> None:
    """Hold streaming state in RocksDB, so that open sessions need not fit in executor memory."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def request_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Requests arriving as JSON-lines files."""
    reader = spark.readStream.schema(REQUESTS)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.json(path)


def _batch_folder(path: str, batch_id: int, part: int = 0) -> str:
    return f"{path}/batch_id={batch_id}/part={part}"


def _write_batch(rows: DataFrame, path: str, batch_id: int, part: int = 0) -> None:
    folder = _batch_folder(path, batch_id, part)
    by_app(rows).write.mode("overwrite").partitionBy("app_id").parquet(folder)


def _start(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str, mode: str,
           once: bool) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint)
    writer = writer.outputMode(mode)
    return (writer.trigger(availableNow=True) if once else writer).start()


def server_time() -> Column:
    """The time a request carries from its front end, else the time of the batch."""
    return F.coalesce("server_ts", F.unix_millis(F.current_timestamp()))


def judge_requests(requests: DataFrame, registry: DataFrame | None) -> DataFrame:
    """Requests with ``fault``: a route nobody knows, or an app that stores no events now; else null."""
    route = F.coalesce("route", F.lit(""))
    fault = F.when(~route.isin(START, FINISH, PREDICT), F.lit("unknown route"))
    if registry is None:
        return requests.withColumn("fault", fault)
    state = registry.select("app_id", F.col("run_state").alias("_state"))
    judged = lookup_join(requests, state, "app_id")
    refused = ~F.coalesce(command_accepted(F.lit("store"), F.col("_state")), F.lit(False))
    reason = F.when(F.col("_state").isNull(), F.lit("unknown app")).when(
        refused, F.concat(F.lit("app is "), "_state")
    )
    return judged.select(*requests.columns, F.coalesce(fault, reason).alias("fault"))


def ingest_batch(
    requests: DataFrame,
    ranges: DataFrame | PlaceIndex,
    out: str,
    batch_id: int,
    registry: DataFrame | None = None,
) -> None:
    """Start and finish requests of one batch to their tables, all others to quarantine with the reason.

    With a ``registry``, only apps whose run state stores events get theirs. Predict
    requests are left to stream_predict().
    """
    requests = requests.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        judged = judge_requests(requests, registry)
        sound = judged.where(F.col("fault").isNull()).drop("fault")
        refused = judged.where(F.col("fault").isNotNull() & ~F.coalesce(F.col("route") == PREDICT, F.lit(False)))
        starts, bad_starts = decode_starts(sound.where(F.col("route") == START))
        finishes, bad_finishes = decode_finishes(sound.where(F.col("route") == FINISH))
        stamped = stamp_server_time(enrich_requests(starts, ranges), server_time())
        _write_batch(stamped.select(*START_EVENTS.names), f"{out}/starts", batch_id)
        _write_batch(
            stamp_server_time(finishes, server_time()).select(*FINISH_EVENTS.names),
            f"{out}/finishes",
            batch_id,
        )
        unread = bad_starts.unionByName(bad_finishes).unionByName(refused)
        _write_batch(unread, f"{out}/quarantine", batch_id)
    finally:
        requests.unpersist()


def stream_ingest(
    requests: DataFrame,
    ranges: DataFrame,
    out: str,
    checkpoint: str,
    once: bool = False,
    registry_path: str | None = None,
) -> StreamingQuery:
    """Continuous ingest of start and finish requests; run states are read anew for each batch."""
    places = place_index(ranges)

    def work(df: DataFrame, batch_id: int) -> None:
        registry = read_registry(df.sparkSession, registry_path) if registry_path else None
        ingest_batch(df, places, out, batch_id, registry)

    return _start(requests, work, checkpoint, "append", once)


def stream_session_sample(
    events: DataFrame, out: str, checkpoint: str, once: bool = False
) -> StreamingQuery:
    """The session sample kept up to date: each batch writes the sessions it changed.

    A session stays open for ever, as a finish counts however late it comes; so its state
    is held on disk.
    """
    keep_state_on_disk(events.sparkSession)

    def work(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(_batch_folder(out, batch_id))

    return _start(session_sample(events), work, checkpoint, "update", once)


def read_session_sample(spark: SparkSession, out: str) -> DataFrame:
    """Newest state of every session written by ``stream_session_sample``."""
    changes = spark.read.option("basePath", out).parquet(f"{out}/batch_id=*/part=*")
    state = [c for c in changes.columns if c not in ("app_id", "session", "batch_id", "part")]
    return (
        changes.groupBy(*SESSION_KEYS)
        .agg(F.max_by(F.struct(*state), F.col("batch_id")).alias("s"))
        .select("app_id", "session", "s.*")
    )


def bounded_session_sample(events: DataFrame, gap: str, delay: str) -> DataFrame:
    """The session sample with bounded state.

    A session closes after ``gap`` without events and leaves the state once the
    watermark has passed it. A finish later than that is lost, which the
    unbounded form never does.
    """
    columns = [c for c in ("event_id", "identity", "variation", "kind") if c in events.columns]
    is_start = F.col("etype") == START
    return (
        events.withColumn("event_time", F.timestamp_millis("ts_ms"))
        .withWatermark("event_time", delay)
        .groupBy(*SESSION_KEYS, F.session_window("event_time", gap).alias("span"))
        .agg(
            F.max_by(F.struct(*columns), F.when(is_start, F.col("event_id"))).alias("latest"),
            F.count_if(is_start).alias("n_start"),
            F.bool_or(F.col("etype") == FINISH).alias("goal"),
        )
        .where(F.col("n_start") > 0)
        .select("app_id", "session", "span", "latest.*", "n_start", "goal")
    )


def stream_predict(
    requests: DataFrame,
    ranges: DataFrame,
    registry_path: str,
    out: str,
    checkpoint: str,
    once: bool = False,
    after_batch: Callable[[int], None] | None = None,
) -> StreamingQuery:
    """Decide predict requests batch by batch and log each decision as a start event.

    Requests that get no decision are written below ``refused`` with the reason. A batch
    run again first clears what the attempt before it has logged.

    The registry is read anew for each batch, so a finished training is used
    from the next batch on. ``after_batch`` is the place for the retrain trigger. The
    ranges are measured and listed once, when the stream starts.
    """
    places = place_index(ranges)

    def work(df: DataFrame, batch_id: int) -> None:
        spark = df.sparkSession
        df = df.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            # Another attempt may have had other plans: nothing of it may stay.
            remove_folder(spark, f"{out}/starts/batch_id={batch_id}")
            registry = read_registry(spark, registry_path)
            wanted, bad = decode_predicts(df.where(F.col("route") == PREDICT))
            enriched = enrich_requests(wanted, places)
            predict_and_log(
                enriched.withColumn("ts_ms", server_time()),
                registry,
                lambda rows, part: _write_batch(rows, f"{out}/starts", batch_id, part),
                F.col("ts_ms"),
            )
            _write_batch(bad, f"{out}/quarantine", batch_id)
            _write_batch(refused_requests(wanted, registry), f"{out}/refused", batch_id)
        finally:
            df.unpersist()
        if after_batch:
            after_batch(batch_id)

    return _start(requests, work, checkpoint, "append", once)


class RetrainTrigger:
    """An ``after_batch`` hook running the retrain cycle at the end of every n-th batch.

    In the background, the stream goes on deciding with the former models while one
    training runs; a trigger that comes meanwhile is left out.
    """

    def __init__(self, retrain: Callable[[], list[str]], every: int = 1, background: bool = False) -> None:
        self.retrain, self.every, self.background = retrain, every, background
        self._pool = ThreadPoolExecutor(max_workers=1) if background else None
        self._running: Future | None = None

    def __call__(self, batch_id: int) -> None:
        if batch_id % self.every:
            return
        if self._pool is None:
            self.retrain()
        elif self._running is None or self._running.done():
            self.wait()
            self._running = self._pool.submit(self.retrain)

    def wait(self) -> None:
        """Wait for the training that runs, and raise what made it fail."""
        if self._running is not None:
            self._running.result()


def retrain_trigger(
    retrain: Callable[[], list[str]], every: int = 1, background: bool = False
) -> RetrainTrigger:
    return RetrainTrigger(retrain, every, background)
