from frames import APP, app, events
from pyspark.sql import functions as F

from splitlane.operators.lookup import dealt
from splitlane.operators.sessions import session_sample
from splitlane.schema import REQUESTS, START_EVENTS
from splitlane.session import scratch_path, settle
from splitlane.sinks import tables as sinks
from splitlane.sinks.tables import by_app
from splitlane.sources import tables as sources
from splitlane.streaming import jobs

V1, V2 = "1".zfill(24), "2".zfill(24)


def test_append_then_scan_by_selector_and_limit(spark):
    path = scratch_path(spark, "starts")
    data = events(spark, [(i, f"s{i}", "start", V1 if i % 2 else V2, {"a": str(i)}) for i in range(10)])
    sinks.append_starts(data, path)
    sinks.append_starts(data.withColumn("app_id", F.lit("other")), path)
    found = sources.scan_starts(spark, path, app_id=APP, variation=V1)
    assert sorted(r.event_id for r in found.collect()) == [1, 3, 5, 7, 9]
    newest = sources.scan_starts(spark, path, limit=3, app_id=APP)
    assert sorted(r.event_id for r in newest.collect()) == [7, 8, 9]
    assert "PartitionFilters: [isnotnull(app_id" in found._jdf.queryExecution().executedPlan().toString()
    assert set(found.columns) == set(START_EVENTS.names)


def test_dump_quotes_values_and_leaves_missing_ones_empty(spark):
    sample = session_sample(events(spark, [
        (1, "s", "start", V1, {"a": 'x,"y"', "b": "1"}), (2, "s", "finish", None, None), (3, "t", "start", V2, {}),
    ]))
    path = sinks.dump_sample(sample.coalesce(1), ["a", "b"], scratch_path(spark, "dump"))
    lines = sorted(r.value for r in spark.read.text(path).collect())
    assert lines == sorted(["a,b,variation,result", f'"x,\\"y\\"",1,{V1},true', f",,{V2},false"])


def test_registry_readers_see_complete_versions_only(spark):
    path = scratch_path(spark, "registry")
    assert sinks.write_registry(app(spark), path) == 1
    assert sinks.write_registry(app(spark, state="Training"), path) == 2
    spark.range(1).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(
        f"{path}/version=3"
    )
    assert sources.registry_versions(spark, path) == [1, 2]
    assert sources.read_registry(spark, path).first().run_state == "Training"


def test_settled_tables_keep_schema_and_rows(spark):
    data = events(spark, [(1, "s", "start", V1, {"a": "b"})])
    again = settle(data, "t", ("app_id",))
    assert again.select(*data.columns).collect() == data.collect()


def requests(spark, rows, path):
    spark.createDataFrame(rows, REQUESTS).coalesce(1).write.mode("append").json(path)


def test_ingest_in_several_batches(spark):
    path = scratch_path(spark, "ingest")
    ranges = spark.createDataFrame([(1, 9, "Town", "Land")], "ip_from bigint, ip_to bigint, city string, country string")
    start = '{"session":"s","variation":"1","identity":{"k":"v"},"timestamp":3}'
    run = lambda: jobs.stream_ingest(
        jobs.request_stream(spark, f"{path}/in", 1), ranges, f"{path}/out", f"{path}/state", once=True
    ).awaitTermination()
    requests(spark, [(1, APP, "start", 5, 100, start), (2, APP, "finish", None, 101, '{"session":"s"}')], f"{path}/in")
    run()
    requests(spark, [(3, APP, "start", None, 102, "oops"), (4, APP, "start", None, None, start)], f"{path}/in")
    run()
    starts = {r.event_id: r for r in sources.scan_starts(spark, f"{path}/out/starts").collect()}
    assert set(starts) == {1, 4}
    assert starts[1].identity == {"k": "v", "userTs": "3", "city": "Town", "country": "Land", "ip": "0.0.0.5"}
    assert starts[1].ts_ms == 100 and starts[4].ts_ms > 1_600_000_000_000
    assert [r.ts_ms for r in sources.scan_finishes(spark, f"{path}/out/finishes").collect()] == [101]
    assert [r.fault for r in spark.read.parquet(f"{path}/out/quarantine").collect()] == ["malformed"]


def test_a_repeated_batch_leaves_its_rows_once(spark):
    path = scratch_path(spark, "repeat")
    ranges = spark.createDataFrame([], "ip_from bigint, ip_to bigint, city string, country string")
    batch = spark.createDataFrame(
        [(1, APP, "start", None, 1, '{"session":"s","variation":"1"}'), (2, APP, "finish", None, 2, "{}")], REQUESTS
    )
    for _ in range(2):
        jobs.ingest_batch(batch, ranges, path, 7)
    assert sources.scan_starts(spark, f"{path}/starts").count() == 1
    assert sources.scan_finishes(spark, f"{path}/finishes").count() == 1


def event_files(spark, path, batches):
    for rows in batches:
        events(spark, rows).coalesce(1).write.mode("append").parquet(path)


BATCHES = [
    [(1, "a", "start", V1, None), (2, "b", "finish", None, None)],
    [(3, "a", "start", V2, None), (4, "b", "start", V1, None)],
    [(500, "a", "finish", None, None), (501, "c", "finish", None, None)],
]


def test_stream_sample_follows_late_finishes(spark):
    path = scratch_path(spark, "sample")
    stream = lambda: spark.readStream.schema(events(spark, []).schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    for batch in BATCHES:
        event_files(spark, f"{path}/in", [batch])
        jobs.stream_session_sample(stream(), f"{path}/out", f"{path}/state", once=True).awaitTermination()
    streamed = jobs.read_session_sample(spark, f"{path}/out").select("session", "event_id", "variation", "goal")
    whole = session_sample(events(spark, [r for b in BATCHES for r in b])).select("session", "event_id", "variation", "goal")
    assert sorted(map(tuple, streamed.collect())) == sorted(map(tuple, whole.collect())) == [
        ("a", 3, V2, True), ("b", 4, V1, True),
    ]


def test_bounded_sample_loses_finishes_beyond_the_gap(spark):
    path = scratch_path(spark, "bounded")
    event_files(spark, f"{path}/in", [[r for b in BATCHES for r in b]])
    stream = spark.readStream.schema(events(spark, []).schema).parquet(f"{path}/in")
    bounded = jobs.bounded_session_sample(stream, "60 seconds", "1 second")
    query = (
        bounded.writeStream.outputMode("append").format("parquet")
        .option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start(f"{path}/out")
    )
    query.awaitTermination()
    closed = spark.read.parquet(f"{path}/out").select("session", "event_id", "goal")
    assert sorted(map(tuple, closed.collect())) == [("a", 3, False), ("b", 4, True)]


def test_retrain_trigger_runs_on_every_nth_batch():
    seen = []
    after = jobs.retrain_trigger(lambda: seen.append(1) or [], every=3)
    for batch_id in range(7):
        after(batch_id)
    assert len(seen) == 3


def test_requests_of_unknown_routes_and_refused_apps_are_kept_apart(spark):
    path = scratch_path(spark, "refused")
    ranges = spark.createDataFrame([], "ip_from bigint, ip_to bigint, city string, country string")
    start = '{"session":"s","variation":"1"}'
    batch = spark.createDataFrame(
        [
            (1, APP, "start", None, 1, start), (2, APP, "visit", None, 1, start), (3, APP, None, None, 1, start),
            (4, "x", "start", None, 1, start), (5, "y", "finish", None, 1, "{}"), (6, "x", "predict", None, 1, "{}"),
        ],
        REQUESTS,
    )
    states = spark.createDataFrame([(APP, "NoData"), ("y", "Suspended")], "app_id string, run_state string")
    jobs.ingest_batch(batch, ranges, path, 0, states)
    assert [r.event_id for r in sources.scan_starts(spark, f"{path}/starts").collect()] == [1]
    away = spark.read.parquet(f"{path}/quarantine").collect()
    assert {r.event_id: r.fault for r in away} == {
        2: "unknown route", 3: "unknown route", 4: "unknown app", 5: "app is Suspended",
    }


def test_overlapping_ranges_leave_an_event_one_row(spark):
    from splitlane.operators.geo import geo_range_join, place_index

    ranges = spark.createDataFrame(
        [(0, 1000, "wide", "L"), (10, 20, "narrow", "L"), (15, 25, "later", "L"), (10, 20, "aaa", "L")],
        "ip_from bigint, ip_to bigint, city string, country string",
    )
    events = spark.createDataFrame([(1, 12), (2, 18), (3, 22), (4, 500), (5, 5000), (6, None)], "event_id bigint, ip_num bigint")
    for where in (ranges, place_index(ranges)):
        got = {r.event_id: r.city for r in geo_range_join(events, where).collect()}
        assert got == {1: "aaa", 2: "aaa", 3: "later", 4: "wide", 5: "<unknown>", 6: None}
        assert geo_range_join(events, where).count() == 6


def test_background_trigger_runs_one_training_at_a_time():
    import threading

    go, seen = threading.Event(), []
    after = jobs.retrain_trigger(lambda: (go.wait(10), seen.append(1)) and [], background=True)
    for batch_id in range(3):
        after(batch_id)
    go.set()
    after.wait()
    assert len(seen) == 1


def test_a_large_app_of_one_task_is_laid_out_by_several(spark):
    settings = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "8"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        one = spark.range(0, 20_000, 1, 1).select(
            F.lit("x").alias("app_id"), F.col("id").alias("event_id"), (F.col("id") % 2 == 0).alias("_scores")
        )
        out = by_app(one, ("_scores", "app_id"))
        # In the order that a write to these folders needs, so that it is not sorted once more.
        assert out.columns == one.columns
        path = scratch_path(spark, "laid")
        out.write.partitionBy("_scores", "app_id").parquet(path)
        assert spark.read.parquet(path).count() == 20_000
        parts = out.rdd.mapPartitions(lambda part: [[(r._scores, r.event_id) for r in part]]).collect()
        assert sum(len(part) > 0 for part in parts) > 1 and sum(map(len, parts)) == 20_000
        assert all(part == sorted(part) for part in parts)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_rows_of_one_file_are_dealt(spark):
    one = spark.range(0, 1_000, 1, 1).withColumnRenamed("id", "event_id")
    out = dealt(one, "event_id")
    assert out.rdd.getNumPartitions() > 1 and sorted(r.event_id for r in out.collect()) == list(range(1_000))
