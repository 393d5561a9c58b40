"""Trees read as data score every request as Spark ML does, for many apps in one plan."""

import pytest
from frames import APP, WEIGHTS_A, WEIGHTS_B, population_app, two_populations, visitors
from pyspark.sql import functions as F

from splitlane.operators import features
from splitlane.operators.trees import FOREST_CLASSIFIER, FOREST_REGRESSOR, TREE_CLASSIFIER, TREE_REGRESSOR, save_model
from splitlane.plans import predict, train
from splitlane.session import scratch_path
from test_training import requests


@pytest.fixture(scope="module")
def prepared(spark):
    return train.prepare_sample(two_populations(spark), population_app(spark))


def people(spark):
    mixed = visitors(WEIGHTS_A, 60, 5) + visitors(WEIGHTS_B, 60, 6) + [{"browser": "new", "os": "new"}, {}] * 5
    return requests(spark, mixed)


@pytest.mark.parametrize("spec", [TREE_REGRESSOR, TREE_CLASSIFIER, FOREST_REGRESSOR, FOREST_CLASSIFIER], ids=lambda s: s.model_type)
def test_scores_equal_spark_ml(spark, prepared, spec):
    model = train.train_app(prepared, APP, spec).model
    path = scratch_path(spark, "model")
    save_model(model, prepared.mapping, path)
    apps = population_app(spark, state="Predicting", predicting_from=1, model_path=path, variations=("1", "2", "3"))
    apps = apps.withColumn("model_type", F.lit(spec.model_type))
    modelled = list(predict.modelled_apps(apps.where(predict.uses_model())))
    configured = features.config_join(people(spark), apps).where(F.size("variations") > 0)
    by_ml = predict.score_apps(configured, modelled, {APP: model}, prepared.mapping)[0]
    as_data = predict.scored_as_data(configured, modelled)
    got = {r.event_id: r.scores for r in as_data.select("event_id", "scores").collect()}
    want = {r.event_id: r.scores for r in by_ml.select("event_id", "scores").collect()}
    assert got.keys() == want.keys() and len(got) == 130
    for key, scores in want.items():
        assert got[key] == pytest.approx(scores, abs=1e-12)
    loaded = predict.choose_variation(people(spark), apps, lambda *_: (model, prepared.mapping))
    tables = predict.choose_variation(people(spark), apps)
    assert sorted(tuple(r) for r in tables.collect()) == sorted(tuple(r) for r in loaded.collect())


def test_many_apps_in_one_plan(spark, prepared):
    model = train.train_app(prepared, APP).model
    ids = [str(i).zfill(24) for i in range(20)]
    one = population_app(spark, state="Predicting", predicting_from=1, model_path="m")
    folders = {}
    for i in ids:
        folders[i] = scratch_path(spark, "model")
        save_model(model, prepared.mapping.withColumn("app_id", F.lit(i)), folders[i])
    paths = spark.createDataFrame(list(folders.items()), "app_id string, model_path string")
    apps = one.drop("app_id", "model_path").crossJoin(paths).withColumn("model_type", F.lit("tree_regressor"))
    everyone = requests(spark, visitors(WEIGHTS_A, 10, 3)).drop("app_id").crossJoin(paths.select("app_id"))
    plans = list(predict.decision_plans(everyone, apps))
    assert len(plans) == 2
    scanned = plans[1]._jdf.queryExecution().optimizedPlan().toString()
    assert scanned.count("Relation [") <= 8
    decided = plans[1]
    loaded = predict.choose_variation(
        everyone, apps, lambda path, _: (model, prepared.mapping.withColumn("app_id", F.lit(dict(map(reversed, folders.items()))[path])))
    )
    assert sorted(tuple(r) for r in decided.collect()) == sorted(tuple(r) for r in loaded.drop("x").collect())
    assert decided.count() == 200


def test_trees_are_copied_once_per_batch(spark, prepared, monkeypatch):
    monkeypatch.setattr(predict, "BATCH_ROWS", 50)
    joined = []
    join = predict.lookup_join

    def spy(facts, lookup, *args, **kwargs):
        if "trees" in lookup.columns:
            joined.append(facts.count())
        return join(facts, lookup, *args, **kwargs)

    monkeypatch.setattr(predict, "lookup_join", spy)
    model = train.train_app(prepared, APP).model
    path = scratch_path(spark, "model")
    save_model(model, prepared.mapping, path)
    apps = population_app(spark, state="Predicting", predicting_from=1, model_path=path)
    apps = apps.withColumn("model_type", F.lit("tree_regressor"))
    modelled = list(predict.modelled_apps(apps))
    # The same request three times over: each comes back.
    asked = people(spark)
    configured = features.config_join(asked.unionByName(asked).unionByName(asked), apps)
    scored = predict.scored_as_data(configured, modelled)
    assert scored.count() == 390 and scored.where("scores is null").count() == 0
    assert joined == [8]
