import pytest
from frames import APP, WEIGHTS_A, WEIGHTS_B, population_app, two_populations, visitors
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import functions as F

from splitlane.operators import features
from splitlane.operators.trees import (
    FOREST_CLASSIFIER,
    FOREST_REGRESSOR,
    TREE_CLASSIFIER,
    TREE_REGRESSOR,
    fit_tree,
    load_model,
    save_model,
    tree_estimator,
)
from splitlane.plans import predict, train
from splitlane.session import scratch_path
from splitlane.sinks.tables import write_registry
from splitlane.sources.tables import read_registry, registry_versions

IDENTITY = "map<string,string>"


@pytest.fixture(scope="module")
def prepared(spark):
    return train.prepare_sample(two_populations(spark), population_app(spark))


@pytest.fixture(scope="module")
def trained(prepared):
    return train.train_app(prepared, APP)


def requests(spark, people, start=100_000):
    rows = [(start + i, APP, f"visit {i}", 0, p) for i, p in enumerate(people)]
    return spark.createDataFrame(
        rows, f"event_id bigint, app_id string, session string, ts_ms bigint, identity {IDENTITY}"
    )


def share_of(decided, variation):
    return decided.agg(F.avg((F.col("variation") == variation.zfill(24)).cast("int"))).first()[0]


def test_model_beats_the_baseline(trained):
    report = trained.report.first()
    assert report.sample_size == 2000
    assert report.error < 0.2 < report.baseline_error
    assert report.precision > 0.8 and report.recall > 0.8


@pytest.mark.parametrize("spec", [TREE_CLASSIFIER, FOREST_CLASSIFIER, FOREST_REGRESSOR], ids=lambda s: s.model_type)
def test_other_models_beat_the_baseline_too(prepared, spec):
    report = train.train_app(prepared, APP, spec).report.first()
    assert report.error < 0.2 < report.baseline_error


def test_each_population_gets_its_favourite(spark, prepared, trained):
    apps = population_app(spark, state="Predicting", predicting_from=1, model_path="m")
    loader = lambda path, kind: (trained.model, prepared.mapping)
    for weights, favourite in ((WEIGHTS_A, "1"), (WEIGHTS_B, "2")):
        decided = predict.choose_variation(requests(spark, visitors(weights, 300, 77)), apps, loader)
        assert decided.count() == 300
        assert share_of(decided, favourite) > 0.85
        assert {r.kind for r in decided.select("kind").distinct().collect()} == {"Predicted"}


@pytest.mark.parametrize("state,since,model,kinds", [
    ("NoData", None, "m", {"Random"}),
    ("Predicting", 1, None, {"Random"}),
    ("Training", None, "m", {"Random"}),
    ("Training", 1, "m", {"Predicted"}),
    ("Suspended", 1, "m", set()),
    ("Loading", None, None, set()),
])
def test_who_decides_in_which_state(spark, prepared, trained, state, since, model, kinds):
    apps = population_app(spark, state=state, predicting_from=since, model_path=model)
    people = requests(spark, visitors(WEIGHTS_A, 40, 3))
    decided = predict.choose_variation(people, apps, lambda *_: (trained.model, prepared.mapping))
    assert {r.kind for r in decided.select("kind").distinct().collect()} == kinds
    assert decided.count() == (40 if kinds else 0)


def test_unseen_values_still_get_a_decision(spark, prepared, trained):
    apps = population_app(spark, state="Predicting", predicting_from=1, model_path="m",
                          variations=("1", "2", "3"))
    people = requests(spark, [{"browser": "new", "os": "new"}, {}] * 20)
    decided = predict.choose_variation(people, apps, lambda *_: (trained.model, prepared.mapping))
    assert decided.where(F.col("variation").isNotNull()).count() == 40


def test_more_apps_than_one_plan_holds(spark, prepared, trained, monkeypatch):
    monkeypatch.setattr(predict, "APPS_PER_PLAN", 2)
    ids = [str(i).zfill(24) for i in range(5)]
    one = population_app(spark, state="Predicting", predicting_from=1, model_path="m")
    apps = one.drop("app_id").crossJoin(spark.createDataFrame([(i,) for i in ids], "app_id string"))
    people = requests(spark, visitors(WEIGHTS_A, 10, 3)).drop("app_id")
    everyone = people.crossJoin(apps.select("app_id"))
    codes = prepared.mapping.drop("app_id").crossJoin(apps.select("app_id"))
    plans = list(
        predict.decision_plans(everyone, apps.select(*one.columns), lambda *_: (trained.model, codes))
    )
    assert len(plans) == 4 and sum(p.count() for p in plans) == 50


@pytest.mark.parametrize("n", [1, 5, 20])
def test_requests_are_read_once_for_any_number_of_apps(spark, prepared, trained, n):
    ids = [str(i).zfill(24) for i in range(n)]
    one = population_app(spark, state="Predicting", predicting_from=1, model_path="m")
    apps = one.drop("app_id").crossJoin(spark.createDataFrame([(i,) for i in ids], "app_id string"))
    people = requests(spark, visitors(WEIGHTS_A, 10, 3)).drop("app_id").crossJoin(apps.select("app_id"))
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    codes = prepared.mapping.drop("app_id").crossJoin(apps.select("app_id"))
    seen = people.select("app_id", "event_id").mapInArrow(counted, "app_id string, event_id bigint")
    watched = people.join(seen, ["app_id", "event_id"])
    plans = list(predict.decision_plans(watched, apps.select(*one.columns), lambda *_: (trained.model, codes)))
    assert sum(p.count() for p in plans) == 10 * n
    assert read.value == 10 * n


def test_model_survives_saving(spark, prepared, trained):
    path = scratch_path(spark, "model")
    save_model(trained.model, prepared.mapping, path)
    again, mapping = load_model(spark, path, "tree_regressor")
    assert again.toDebugString == trained.model.toDebugString
    assert mapping.exceptAll(prepared.mapping).count() == 0


def test_class_as_position(spark):
    """A classifier fitted on identity alone, labelled by the favourite's position."""
    people = [(p, 0.0) for p in visitors(WEIGHTS_A, 300, 1)] + [(p, 1.0) for p in visitors(WEIGHTS_B, 300, 2)]
    apps = population_app(spark, state="Predicting", predicting_from=1, model_path="m")
    rows = spark.createDataFrame(
        [(i, APP, str(i), p, label) for i, (p, label) in enumerate(people)],
        f"event_id bigint, app_id string, session string, identity {IDENTITY}, label double",
    )
    hashed = features.config_join(rows, apps).withColumn(
        "features", features.identity_features(F.col("identity"), F.col("descriptors"))
    )
    mapping = features.category_mapping(
        features.infer_supports(hashed), features.categorical_positions(apps)
    )
    coded = features.remap_sample(hashed, mapping, 3)
    arities = {r.pos: r.arity for r in mapping.select("pos", "arity").distinct().collect()}
    model = fit_tree(coded, arities, ["browser", "os", "lang"], TREE_CLASSIFIER)
    configured = features.config_join(requests(spark, visitors(WEIGHTS_B, 100, 9)), apps)
    decided = predict.classify_app(configured, model, mapping, 3)
    assert share_of(decided, "2") > 0.85


def test_any_estimator_may_be_passed(prepared):
    shallow = DecisionTreeRegressor(featuresCol="vector", labelCol="label", maxDepth=1, maxBins=64)
    assert train.train_app(prepared, APP, estimator=shallow).model.depth == 1


def test_fixed_settings():
    tree = tree_estimator(TREE_REGRESSOR, 10)
    assert (tree.getMaxDepth(), tree.getMaxBins(), tree.getImpurity()) == (24, 4096, "variance")
    forest = tree_estimator(FOREST_REGRESSOR, 1000)
    assert (forest.getNumTrees(), forest.getFeatureSubsetStrategy()) == (31, "auto")
    tree = tree_estimator(TREE_CLASSIFIER, 10)
    assert (tree.getMaxDepth(), tree.getMaxBins(), tree.getImpurity()) == (16, 512, "gini")
    assert tree_estimator(FOREST_CLASSIFIER, 1000).getNumTrees() == 3


def test_descriptor_hash_can_be_replaced(spark):
    sample = spark.createDataFrame(
        [(APP, "s", 1, {"browser": "abc"}, "1".zfill(24), True)],
        f"app_id string, session string, event_id bigint, identity {IDENTITY}, variation string, goal boolean",
    )
    length = lambda v: F.coalesce(F.length(v), F.lit(-1)).cast("double")
    row = features.feature_vector(sample, population_app(spark), length).first()
    assert row.features == [3.0, -1.0, -1.0, 0.0]


def test_retrain_cycle_sets_model_and_state_together(spark):
    path = scratch_path(spark, "cycle")
    write_registry(population_app(spark), f"{path}/registry")
    where = (f"{path}/registry", f"{path}/models", f"{path}/metrics")
    data = two_populations(spark, 200)
    assert train.retrain_cycle(data, *where, now_ms=999_999_999) == [APP]
    row = read_registry(spark, where[0]).first()
    assert (row.run_state, row.predicting_from, row.model_type) == ("Predicting", 999_999_999, "tree_regressor")
    load_model(spark, row.model_path, row.model_type)
    assert spark.read.parquet(where[2]).first().sample_size == 400
    states = [
        spark.read.parquet(f"{where[0]}/version={v}").first().run_state
        for v in registry_versions(spark, where[0])
    ]
    assert states == ["NoData", "Training", "Predicting"]
    # Nothing happened since, so nothing is retrained.
    assert train.retrain_cycle(data, *where) == []


def test_several_apps_are_trained_side_by_side(spark):
    path = scratch_path(spark, "cycle")
    ids = [str(i).zfill(24) for i in range(5)]
    apps = spark.createDataFrame([(i,) for i in ids], "app_id string")
    one = population_app(spark)
    write_registry(one.drop("app_id").crossJoin(apps).select(*one.columns), f"{path}/registry")
    data = two_populations(spark, 60).drop("app_id").crossJoin(apps)
    where = (f"{path}/registry", f"{path}/models", f"{path}/metrics")
    assert sorted(train.retrain_cycle(data, *where, parallel=5)) == ids
    assert {r.run_state for r in read_registry(spark, where[0]).collect()} == {"Predicting"}
    assert sorted(r.app_id for r in spark.read.parquet(where[2]).collect()) == ids


def test_failed_training_falls_back_to_no_data(spark, monkeypatch):
    path = scratch_path(spark, "cycle")
    write_registry(
        population_app(spark, state="Predicting", predicting_from=1, model_path="old"), f"{path}/registry"
    )
    where = (f"{path}/registry", f"{path}/models", f"{path}/metrics")

    def fail(*args, **kwargs):
        raise RuntimeError("no luck")

    monkeypatch.setattr(train, "train_app", fail)
    train.retrain_cycle(two_populations(spark, 100), *where)
    row = read_registry(spark, where[0]).first()
    assert (row.run_state, row.predicting_from) == ("NoData", None)


def test_rows_of_a_fit_are_dealt_over_the_cores(spark, prepared, monkeypatch):
    monkeypatch.setattr(train, "TASK_VISITS", 5_000)
    seen, fit = [], train.fit_tree

    def spy(rows, *args):
        seen.append((rows.rdd.getNumPartitions(), sorted(r.session for r in rows.collect())))
        return fit(rows, *args)

    monkeypatch.setattr(train, "fit_tree", spy)
    train.train_app(prepared, APP, FOREST_REGRESSOR)
    (tasks, sessions), = seen
    assert tasks > 1
    assert sessions == sorted(r.session for r in prepared.sample.where("train").collect())


def test_a_forest_sends_no_trees_to_its_tasks(prepared):
    rows = prepared.sample.where("train")
    estimator = tree_estimator(FOREST_REGRESSOR, 100)
    assert estimator.getCacheNodeIds()
    grown = [
        fit_tree(rows, prepared.arities(APP), prepared.names(APP), FOREST_REGRESSOR, 100, e).toDebugString.split("\n", 1)[1]
        for e in (estimator, estimator.copy({estimator.cacheNodeIds: False}))
    ]
    assert grown[0] == grown[1]


def test_a_fit_uses_every_training_row(spark, monkeypatch):
    class Seen(Exception):
        pass

    def spy(rows, arities, names, spec, n_rows, estimator):
        raise Seen(rows.count(), n_rows)

    monkeypatch.setattr(train, "fit_tree", spy)
    many = 2_400_000
    sample = spark.range(many, numPartitions=4).select(
        F.lit(APP).alias("app_id"), F.col("id").cast("string").alias("session"), F.lit(True).alias("train")
    )
    codes = spark.createDataFrame([], "app_id string, pos int, raw double, code int, arity bigint")
    with pytest.raises(Seen) as seen:
        train.train_app(train.Prepared(sample, codes, population_app(spark)), APP)
    assert seen.value.args == (many, many)
