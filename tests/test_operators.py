import math

import pytest
from frames import APP, app, events
from pyspark.sql import Window
from pyspark.sql import functions as F

from splitlane.operators import counts, evaluate, features, latest, registry, sessions
from splitlane.operators.assign import argmax_variation, pick_best
from splitlane.operators.filters import finishes_of, starts_of
from splitlane.operators.geo import geo_range_join
from splitlane.operators.lookup import lookup_join
from splitlane.operators.running import max_before
from splitlane.operators.trees import CategoryLimitError, check_categories, vector_metadata
from splitlane.schema import RUN_STATES

V1, V2, V9 = "1".zfill(24), "2".zfill(24), "9".zfill(24)

SESSIONS = [
    (1, "early", "finish", None, None),
    (2, "early", "start", V1, {"browser": "a"}),
    (3, "only finish", "finish", None, None),
    (4, "twice", "start", V1, {"browser": "a"}),
    (5, "twice", "start", V2, {"browser": "b"}),
    (6, "", "start", V1, None),
    (7, "", "start", V2, None),
    (8, "", "finish", None, None),
    (9, "unknown", "start", V9, None),
]


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_session_sample_rules(spark):
    sample = sessions.session_sample(events(spark, SESSIONS))
    assert rows(sample, "session", "event_id", "variation", "n_start", "goal") == [
        ("", 7, V2, 2, True),
        ("early", 2, V1, 1, True),
        ("twice", 5, V2, 2, False),
        ("unknown", 9, V9, 1, False),
    ]


def test_pair_join_gives_the_same_sample(spark):
    data = events(spark, SESSIONS)
    joined = sessions.session_pair_join(starts_of(data), finishes_of(data))
    columns = ("session", "event_id", "variation", "goal")
    assert rows(joined, *columns) == rows(sessions.session_sample(data), *columns)


def test_blank_sessions_and_kinds_can_be_left_out(spark):
    data = events(spark, SESSIONS)
    assert "" not in [r.session for r in sessions.session_sample(sessions.drop_blank_sessions(data)).collect()]
    assert sessions.session_sample(data, kinds=("Predicted",)).count() == 0


def many_events(spark, rows=40000):
    """One group holds most rows, and ids are sparse in another."""
    return spark.range(rows).select(
        F.when(F.col("id") % 10 == 0, F.lit("small")).otherwise(F.lit("big")).alias("app_id"),
        F.when(F.col("id") % 3 == 0, F.lit("finish")).otherwise(F.lit("start")).alias("etype"),
        F.when(F.col("id") % 10 == 0, F.col("id") * 1000003).otherwise(F.col("id")).alias("event_id"),
    )


def plain_latest(df, n):
    w = Window.partitionBy("app_id", "etype").orderBy(F.col("event_id").desc())
    return df.withColumn("r", F.row_number().over(w)).where(F.col("r") <= n).drop("r")


@pytest.mark.parametrize("n", [1, 7, 500, 100000])
def test_latest_n_is_exact(spark, n):
    data = many_events(spark)
    assert rows(latest.latest_n(data, n), "app_id", "event_id") == rows(plain_latest(data, n), "app_id", "event_id")


@pytest.mark.parametrize("n", [7, 5000])
def test_latest_n_in_two_steps_is_exact(spark, no_broadcast, monkeypatch, n):
    monkeypatch.setattr(latest, "FINE_SPAN", 64)
    monkeypatch.setattr(latest, "COARSE_SPAN", 4096)
    data = many_events(spark)
    assert rows(latest.latest_n(data, n), "app_id", "event_id") == rows(plain_latest(data, n), "app_id", "event_id")


def test_no_cap_keeps_all(spark):
    data = many_events(spark, 100)
    assert latest.latest_n(data, None).count() == 100


def test_big_lookup_joins_like_a_small_one(spark, no_broadcast):
    facts = spark.range(3000).select("id", F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise(F.lit("cold")).alias("k"))
    facts = facts.unionByName(spark.createDataFrame([(9999, "none"), (9998, None)], "id bigint, k string"))
    lookup = spark.createDataFrame([("hot", 1), ("cold", 2), ("unused", 3)], "k string, v int")
    for how in ("left", "inner", "left_semi", "left_anti"):
        assert rows(lookup_join(facts, lookup, "k", how), F.col("id")) == rows(
            facts.join(lookup, "k", how), F.col("id")
        )
    plan = lookup_join(facts, lookup, "k")._jdf.queryExecution().optimizedPlan().toString()
    assert "_salt" in plan


PLACES = "ip_from bigint, ip_to bigint, city string, country string"


def test_geo_ranges(spark):
    ranges = spark.createDataFrame(
        [(100, 199, "A", "X"), (200, 9000, None, "Y"), (20000, 20000, "C", None)], PLACES
    )
    visits = spark.createDataFrame(
        [(1, 100), (2, 199), (3, 5000), (4, 9001), (5, 20000), (6, None)], "id int, ip_num bigint"
    )
    expected = [
        (1, "A", "X"), (2, "A", "X"), (3, "<unknown>", "Y"), (4, "<unknown>", "<unknown>"),
        (5, "C", "<unknown>"), (6, None, None),
    ]
    placed = geo_range_join(visits, ranges)
    assert placed.columns == ["id", "ip_num", "city", "country"]
    assert rows(placed, "id", "city", "country") == expected


def disjoint_ranges(count=400, seed=8):
    """Ranges of very different widths with gaps between some of them."""
    import random

    draws, at, made = random.Random(seed), 3, []
    for i in range(count):
        at += draws.choice([0, 0, 1, 50])
        width = draws.choice([1, 1, 2, 15, 16, 17, 255, 256, 257, 4096, 70000])
        made.append((at, at + width - 1, f"city {i}", f"land {i % 7}"))
        at += width
    return made


@pytest.mark.parametrize("broadcast", [True, False])
def test_geo_ranges_of_all_widths_against_a_search(spark, broadcast, monkeypatch):
    import bisect
    import random

    from splitlane.operators import geo

    if not broadcast:
        monkeypatch.setattr(geo, "RANGE_ROWS", 1)
    made = disjoint_ranges()
    draws = random.Random(2)
    edges = [e for low, high, *_ in made for e in (low - 1, low, high, high + 1)]
    visits = [(i, ip) for i, ip in enumerate(edges + [draws.randrange(made[-1][1] + 99) for _ in range(2000)])]
    starts = [low for low, *_ in made]

    def search(ip):
        at = bisect.bisect_right(starts, ip) - 1
        return made[at][2:] if at >= 0 and ip <= made[at][1] else ("<unknown>", "<unknown>")

    placed = geo_range_join(
        spark.createDataFrame(visits, "id int, ip_num bigint"), spark.createDataFrame(made, PLACES)
    )
    assert {r.id: (r.city, r.country) for r in placed.collect()} == {i: search(ip) for i, ip in visits}
    assert placed.count() == len(visits)


def test_no_ranges_at_all(spark):
    visits = spark.createDataFrame([(1, 5)], "id int, ip_num bigint")
    placed = geo_range_join(visits, spark.createDataFrame([], PLACES))
    assert rows(placed, "city", "country") == [("<unknown>", "<unknown>")]


def test_status_counts_raw_events_after_the_epoch(spark):
    status = counts.app_status(events(spark, SESSIONS), app(spark), since=2000)
    assert rows(status, "n_start", "n_finish") == [(5, 2)]


@pytest.mark.parametrize("state,since,expected", [
    ("NoData", None, True), ("Predicting", 0, True), ("Predicting", 60_000, False),
    ("Training", None, False), ("Suspended", None, False), ("Loading", None, False),
])
def test_eligibility_by_state(spark, state, since, expected):
    data = [(i, f"s{i}", "start", V1, None) for i in range(1, 51)]
    data += [(50 + i, f"s{i}", "finish", None, None) for i in range(1, 21)]
    eligible = counts.retrain_eligible(events(spark, data), app(spark, state=state, predicting_from=since))
    assert (eligible.count() == 1) == expected


def test_eligibility_needs_both_counts(spark):
    few = [(i, f"s{i}", "start", V1, None) for i in range(1, 50)]
    few += [(50 + i, f"s{i}", "finish", None, None) for i in range(30)]
    assert counts.retrain_eligible(events(spark, few), app(spark)).count() == 0


def vectors(spark, data, registry_):
    sample = sessions.session_sample(events(spark, data))
    return features.feature_vector(sample, registry_)


def test_unknown_variations_are_left_out_of_training(spark):
    made = vectors(spark, SESSIONS, app(spark))
    assert rows(made, "session") == [("",), ("early",), ("twice",)]
    by_session = {r.session: r for r in made.collect()}
    assert by_session["early"].features == [97.0, 0.0] and by_session["early"].label == 1.0
    assert by_session[""].features == [2433880.0, 1.0]


DESCRIBED = (("same", True), ("flag", True), ("number", False), ("still", False))


def described(spark):
    data = [
        (i, f"s{i}", "start", V1 if i % 2 else V2,
         {"same": "x", "flag": "abc"[i % 3], "number": str(i), "still": "y"})
        for i in range(1, 13)
    ]
    return vectors(spark, data, app(spark, descriptors=DESCRIBED)), app(spark, descriptors=DESCRIBED)


def test_only_categorical_and_explanatory_features_are_mapped(spark):
    made, apps = described(spark)
    supports = features.infer_supports(made)
    assert rows(features.support_sizes(supports), "pos", "arity") == [(0, 1), (1, 3), (2, 12), (3, 1), (4, 2)]
    assert rows(features.explanatory_features(supports), "pos") == [(1,), (2,), (4,)]
    mapping = features.category_mapping(supports, features.categorical_positions(apps))
    assert rows(mapping, "pos", "raw", "code", "arity") == [
        (1, 97.0, 0, 3), (1, 98.0, 1, 3), (1, 99.0, 2, 3), (4, 0.0, 0, 2), (4, 1.0, 1, 2),
    ]
    coded = features.remap_sample(made, mapping, 5)
    row = [r for r in coded.collect() if r.session == "s4"][0]
    assert row.features[1] == 1.0 and row.features[0] == float(ord("x")) and row.features[2] == float(ord("4"))


def test_codes_rank_whole_values_across_spans(spark):
    values = [-2147483648.0, -65537.0, -1.0, 0.0, 1.0, 65535.0, 65536.0, 2147483647.0]
    supports = spark.createDataFrame([(APP, 0, v) for v in values], "app_id string, pos int, raw double")
    places = spark.createDataFrame([(APP, 0)], "app_id string, pos int")
    mapping = features.category_mapping(supports, places)
    assert rows(mapping, "raw", "code") == [(v, i) for i, v in enumerate(values)]


def test_coding_without_broadcast_is_the_same(spark, no_broadcast):
    made, apps = described(spark)
    supports = features.infer_supports(made)
    mapping = features.category_mapping(supports, features.categorical_positions(apps))
    coded = {r.session: r.features for r in features.remap_sample(made, mapping, 5).collect()}
    assert len(coded) == 12 and coded["s4"][1] == 1.0 and coded["s5"][1] == 2.0


def test_unseen_values_become_a_seen_code(spark):
    mapping = spark.createDataFrame(
        [(APP, 0, float(ord(c)), i, 3) for i, c in enumerate("abc")],
        "app_id string, pos int, raw double, code int, arity bigint",
    )
    new = spark.range(300).select(
        F.lit(APP).alias("app_id"), "id",
        F.array(F.lit(500.0) + F.col("id"), F.lit(7.0)).alias("features"),
    )
    coded = features.encode_unseen(new, mapping, 2, "id")
    assert {r.features[0] for r in coded.collect()} == {0.0, 1.0, 2.0}
    assert {r.features[1] for r in coded.collect()} == {7.0}


def test_feature_rows_of_wrong_width_are_refused(spark):
    bad = spark.createDataFrame([(APP, [1.0])], "app_id string, features array<double>")
    with pytest.raises(Exception, match="feature rows differ in width"):
        features.to_feature_frame(bad, app(spark)).collect()


def test_too_many_categories_are_refused_by_name():
    with pytest.raises(CategoryLimitError, match="'ip' has 500 values"):
        check_categories({0: 3, 1: 500}, ["browser", "ip", "variation"], 4096, 350)
    check_categories({0: 3, 1: 500}, ["browser", "ip", "variation"], 4096, 500)


def test_vector_metadata_marks_categories():
    made = vector_metadata({1: 4}, ["a", "b"])["ml_attr"]
    assert made["num_attrs"] == 2
    assert made["attrs"]["nominal"] == [{"idx": 1, "name": "b", "num_vals": 4, "ord": False}]


def test_precision_without_predicted_positives_is_nan(spark):
    data = spark.createDataFrame([(1.0, 0.2), (0.0, 0.4), (0.0, -0.5)], "label double, score double")
    out = evaluate.evaluate_binary(data, F.col("label"), F.col("score")).first()
    assert (out.tp, out.fp, out.fn, out.n) == (0, 0, 1, 3)
    assert math.isnan(out.precision) and out.recall == 0.0 and abs(out.error - 1 / 3) < 1e-12


def test_split_by_seed_or_by_session(spark):
    data = spark.range(2000).select(F.lit(APP).alias("app_id"), F.col("id").cast("string").alias("session"))
    for seed in (None, 3):
        first, second = evaluate.train_test_split(data, seed=seed)
        assert first.count() + second.count() == 2000 and 1300 < first.count() < 1500


def test_argmax_ties_go_to_the_lower_position(spark):
    scored = spark.createDataFrame(
        [(1, 0, 0.5), (1, 1, 0.5), (1, 2, 0.1), (2, 0, 0.1), (2, 1, 0.9)], "v int, variation_idx int, score double"
    )
    assert rows(argmax_variation(scored, "v"), "v", "variation_idx") == [(1, 0), (2, 1)]


def test_jitter_only_decides_close_calls(spark):
    visits = spark.range(500).select(
        F.lit(APP).alias("app_id"), F.col("id").alias("event_id"),
        F.array(F.lit(0.5), F.when(F.col("id") < 250, F.lit(0.5)).otherwise(F.lit(0.6))).alias("scores"),
    )
    configured = features.config_join(visits, app(spark))
    best = pick_best(configured).groupBy(F.col("event_id") < 250, "variation_idx").count().collect()
    counts_ = {(r[0], r.variation_idx): r["count"] for r in best}
    assert counts_[(False, 1)] == 250 and (False, 0) not in counts_
    assert 90 < counts_[(True, 0)] < 160


def simulated(state, commands):
    """States and answers of the commands one after another."""
    out = []
    for c in commands:
        ok = {
            "reload": True,
            "start": state == "Suspended",
            "stop": state != "Loading",
            "status": state != "Loading",
            "config": state != "Loading",
            "predict": state not in ("Loading", "Suspended"),
            "store": state not in ("Loading", "Suspended"),
            "dump": state not in ("Loading", "Suspended"),
            "train": state not in ("Loading", "Suspended", "Training"),
        }[c]
        new = {"start": "NoData", "stop": "Suspended"}.get(c, state) if ok else state
        out.append((state, ok, new))
        state = new
    return out


ALL_COMMANDS = ("reload", "start", "stop", "status", "config", "predict", "store", "dump", "train")


def registry_of(spark, states):
    parts = [app(spark, state=s, app_id=i, predicting_from=1) for i, s in states.items()]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole


def test_every_state_with_every_command(spark):
    states = {f"{s}/{c}": s for s in RUN_STATES for c in ALL_COMMANDS}
    sent = spark.createDataFrame(
        [(n, a, a.split("/")[1]) for n, a in enumerate(states)], "command_id bigint, app_id string, command string"
    )
    for r in registry.apply_commands(registry_of(spark, states), sent).collect():
        assert (r.run_state, r.accepted, r.new_state) == simulated(states[r.app_id], [r.command])[0], r


def test_commands_follow_each_other(spark, monkeypatch):
    import random

    from splitlane.operators import running

    monkeypatch.setattr(running, "SPAN", 8)
    draws = random.Random(11)
    states = {s: s for s in RUN_STATES}
    sent = [(n, draws.choice(RUN_STATES), draws.choice(ALL_COMMANDS)) for n in range(300)]
    apps = registry_of(spark, states)
    judged = registry.apply_commands(
        apps, spark.createDataFrame(sent, "command_id bigint, app_id string, command string")
    )
    expected = {}
    for s in RUN_STATES:
        own = [(n, c) for n, a, c in sent if a == s]
        for (n, _), outcome in zip(own, simulated(s, [c for _, c in own])):
            expected[n] = outcome
    got = {r.command_id: (r.run_state, r.accepted, r.new_state) for r in judged.collect()}
    assert got == expected
    final = registry.registry_update(apps, registry.state_changes(judged))
    last = {s: simulated(s, [c for _, a, c in sent if a == s])[-1][2] for s in RUN_STATES}
    assert {r.app_id: r.run_state for r in final.collect()} == last


def test_max_before_crosses_spans(spark, monkeypatch):
    from splitlane.operators import running

    monkeypatch.setattr(running, "SPAN", 4)
    data = spark.range(30).select(F.lit("k").alias("k"), "id", ((F.col("id") * 7) % 13).alias("x"))
    got = {r.id: r.m for r in max_before(data, ["k"], "id", m=F.col("x")).collect()}
    values = [(i * 7) % 13 for i in range(30)]
    assert got == {i: max(values[:i], default=None) for i in range(30)}


def test_create_keeps_taken_ids_and_takes_the_first_request(spark):
    asked = spark.createDataFrame(
        [(1, APP, [("x", "y")], [("n", True)]), (3, "new", [("late", "l")], []), (2, "new", [("first", "f")], [])],
        "request_id int, app_id string, variations array<struct<id:string,value:string>>, "
        "descriptors array<struct<name:string,categorical:boolean>>",
    )
    made = {r.app_id: r for r in registry.registry_create(app(spark, state="Training"), asked).collect()}
    assert made[APP].run_state == "Training" and len(made) == 2
    assert made["new"].run_state == "NoData" and made["new"].variations[0].id == "first"


def test_update_keeps_fields_not_given_and_ignores_unknown_apps(spark):
    changes = spark.createDataFrame(
        [(APP, 2, None, "later"), (APP, 1, "Training", "early"), ("other", 3, "NoData", None)],
        "app_id string, seq int, run_state string, model_path string",
    )
    out = registry.registry_update(app(spark), changes).collect()
    assert len(out) == 1 and (out[0].run_state, out[0].model_path) == ("Training", "later")


def test_update_where_leaves_unmatched_and_null_alone(spark):
    data = spark.createDataFrame([(1, "a"), (None, "b"), (3, "c")], "x int, y string")
    out = registry.update_where(data, F.col("x") > 1, y=F.lit("new"))
    assert sorted(r.y for r in out.collect()) == ["a", "b", "new"]


def test_recovery(spark):
    out = registry.recover_registry(registry_of(spark, {s: s for s in RUN_STATES}))
    assert {r.app_id: r.run_state for r in out.collect()}["Training"] == "NoData"


def test_big_lookup_copies_rows_of_hot_keys_alone(spark, no_broadcast, monkeypatch):
    from splitlane.operators import lookup as L

    monkeypatch.setattr(L, "HOT_ROWS", 100)
    monkeypatch.setattr(L, "TASK_ROWS", 1000)
    number = F.col("id")
    key = F.when(number % 3 == 0, F.lit("hot")).when(number % 3 == 1, F.concat(F.lit("k"), (number % 500).cast("string")))
    facts = spark.range(6000).select("id", key.alias("k"))
    table = spark.range(500).select(F.concat(F.lit("k"), "id").alias("k"), F.col("id").alias("v"))
    table = table.unionByName(spark.createDataFrame([("hot", -1), ("hot", -2), (None, -3)], "k string, v bigint"))
    for how in ("left", "inner", "left_semi", "left_anti"):
        got = lookup_join(facts, table, "k", how).orderBy("id", *(["v"] if how in ("left", "inner") else []))
        want = facts.join(table, "k", how).orderBy("id", *(["v"] if how in ("left", "inner") else []))
        assert got.columns == want.columns and got.collect() == want.collect()
    total, hot = L._hot_keys(facts, ["k"])
    assert total == 6000 and sorted(map(tuple, hot.collect()), key=str) == [("hot", 20), (None, 20)]
    copied = L._salts_of(table, ["k"], hot).groupBy("_salts").count().collect()
    # The null row matches nothing; only rows of hot keys are multiplied.
    assert {r["_salts"]: r["count"] for r in copied} == {1: 500, 20: 3}
    plan = lookup_join(facts, table, "k")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("REPARTITION_BY_NUM") == 2


def test_carry_rows_are_one_per_partition(spark, monkeypatch):
    from splitlane.operators import running

    monkeypatch.setattr(running, "SPAN", 50)
    seen = []
    join = running.lookup_join

    def spy(facts, lookup, *args, **kwargs):
        seen.append(lookup.count())
        return join(facts, lookup, *args, **kwargs)

    monkeypatch.setattr(running, "lookup_join", spy)
    data = spark.range(1000).select((F.col("id") % 200).alias("k"), "id")
    assert max_before(data, ["k"], "id", m=F.col("id")).where("m != id - 200").count() == 0
    # 200 groups in 20 partitions: at most the first group of a partition began before it.
    assert seen[0] <= 20
