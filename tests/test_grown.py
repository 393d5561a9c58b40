"""Forests grown from counted rows: Spark ML's induction, scores and layout."""

import random

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import RandomForestRegressionModel
from pyspark.sql import functions as F

from splitlane.operators import grown
from splitlane.operators.trees import FOREST_REGRESSOR, TREE_REGRESSOR, fit_tree, load_model, save_model, score_rows, tree_estimator
from splitlane.session import scratch_path

ARITIES = {0: 5, 1: 9, 3: 2}
NAMES = ["segment", "nation", "day", "variation"]


def sample(spark, n=1500, seed=3):
    draws = random.Random(seed)
    rows = []
    for i in range(n):
        x = [float(draws.randrange(5)), float(min(draws.randrange(12), 8)), float(draws.randrange(7) * 31 - 40), float(draws.randrange(2))]
        rows.append((i, x, float(draws.random() < 0.1 + 0.12 * x[0] * x[3] + (0.3 if x[2] > 60 and x[1] < 4 else 0))))
    return spark.createDataFrame(rows, "id bigint, features array<double>, label double")


def nodes_of(spark, model):
    path = scratch_path(spark, "model")
    model.write().save(path)
    read = spark.read.parquet(f"{path}/data")
    nodes = read.select("nodeData.*") if "nodeData" in read.columns else read
    said = {}
    for r in nodes.collect():
        # Spark ML lists the categories of a split in an order of its own.
        said[r.id] = (r.leftChild, r.rightChild, r.split.featureIndex, r.split.numCategories, r.rawCount,
                      sorted(r.split.leftCategoriesOrThreshold), list(r.impurityStats), r.prediction, r.impurity, r.gain)
    return said


def test_one_tree_is_spark_mls(spark):
    """Without draws, with all features at each node."""
    rows = sample(spark)
    single = fit_tree(rows, ARITIES, NAMES, TREE_REGRESSOR)
    table = rows.groupBy("features", "label").agg(F.count("*").alias("n")).collect()
    table.sort(key=lambda r: (r.features, r.label))
    x, of = np.unique(np.array([r.features for r in table]), axis=0, return_inverse=True)
    label, count = np.array([r.label for r in table]), np.array([r.n for r in table])
    bins, cuts = grown.binned(x, np.bincount(of, count), ARITIES, 4096)
    sums = tuple(np.bincount(of, count * label**i) for i in range(3))
    tree = grown.grow(np.random.default_rng(0), bins, cuts, sums, 24, 4)
    want = nodes_of(spark, single)
    assert len(tree["feature"]) == len(want) > 100
    for i, (left, right, feature, categories, n, parts, stats, prediction, impurity, gain) in want.items():
        assert (tree["feature"][i], tree["right"][i]) == (feature, right)
        assert left in (-1, i + 1)
        mine = [tree["threshold"][i]] if categories < 0 else list(tree["cat"][tree["cat_node"] == i])
        assert feature < 0 or mine == parts
        assert [tree["n"][i], tree["total"][i], tree["squares"][i]] == stats and tree["n"][i] == n
        assert (tree["prediction"][i], tree["impurity"][i], tree["gain"][i]) == pytest.approx((prediction, impurity, gain), abs=1e-15)


def test_scores_are_those_of_the_saved_forest(spark):
    rows = sample(spark)
    model = fit_tree(rows, ARITIES, NAMES, FOREST_REGRESSOR)
    path = scratch_path(spark, "model")
    save_model(model, rows.limit(1), path)
    again, _ = load_model(spark, path, "forest_regressor")
    assert isinstance(again, RandomForestRegressionModel)
    assert (again.getNumTrees, again.numFeatures, again.getMaxDepth()) == (38, 4, 24)
    assert nodes_of(spark, model.spark_ml()).keys() == nodes_of(spark, again).keys()
    # Rows never seen, repeated ones, and a value between those seen.
    asked = sample(spark, 300, 11).unionByName(sample(spark, 300, 11)).unionByName(
        spark.createDataFrame([(-1, [4.0, 8.0, 7.5, 1.0], 0.0)], "id bigint, features array<double>, label double")
    )
    both = score_rows(again, score_rows(model, asked).withColumnRenamed("score", "mine")).collect()
    assert len(both) == 601
    assert all(r.mine == pytest.approx(r.score, abs=1e-12) for r in both)
    assert model.getNumTrees == 38 and "numTrees=38" in model.toDebugString


def test_scores_in_many_blocks(spark, monkeypatch):
    rows = sample(spark)
    model = fit_tree(rows, ARITIES, NAMES, FOREST_REGRESSOR)
    whole = {r.id: r.score for r in score_rows(model, rows).collect()}
    monkeypatch.setattr(grown, "BLOCK_ROWS", 10)
    monkeypatch.setattr(grown, "HELD_BLOCKS", 2)
    monkeypatch.setattr(grown, "BROADCAST_BYTES", 0)
    assert {r.id: r.score for r in score_rows(model, rows).collect()} == pytest.approx(whole, abs=1e-12)
    assert len(whole) == 1500


def test_forests_are_as_good_as_spark_mls(spark):
    """Held against the chances that labels are drawn by: equal mean errors, and as many nodes."""
    rows, fresh = sample(spark, 3000, 5), sample(spark, 3000, 6)
    mine = fit_tree(rows, ARITIES, NAMES, FOREST_REGRESSOR)
    theirs = fit_tree(rows, ARITIES, NAMES, FOREST_REGRESSOR, 3000, tree_estimator(FOREST_REGRESSOR, 3000))
    errors = [score_rows(m, fresh).agg(F.avg((F.col("score") - F.col("label")) ** 2)).first()[0] for m in (mine, theirs)]
    assert errors[0] == pytest.approx(errors[1], rel=0.02)
    assert mine.totalNumNodes == pytest.approx(theirs.totalNumNodes, rel=0.03)


def test_the_same_forest_whatever_the_order_of_its_rows(spark):
    rows = sample(spark)
    models = [fit_tree(r, ARITIES, NAMES, FOREST_REGRESSOR) for r in (rows, rows.orderBy(F.rand(1)).repartition(7))]
    first, second = ([tuple(r) for r in m.node_rows().orderBy("treeID", "nodeData.id").collect()] for m in models)
    assert first == second


def test_no_task_meets_more_rows_than_there_are_different_ones(spark, monkeypatch):
    """Work follows the different rows: 20 copies of each add trees, but no rows to a tree."""
    seen, grower = [], grown._grower

    def spy(bins, cuts, of, label, count, *settings):
        seen.append((len(of), int(count.sum())))
        return grower(bins, cuts, of, label, count, *settings)

    monkeypatch.setattr(grown, "_grower", spy)
    few = sample(spark, 400)
    many = few.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(20))))
    assert fit_tree(many, ARITIES, NAMES, FOREST_REGRESSOR).n_trees == 89
    (rows, drawn), = seen
    assert drawn == 8000 and rows <= 400


def test_more_different_rows_than_a_task_holds_go_to_spark_ml(spark, monkeypatch):
    monkeypatch.setattr(grown, "MOST_ROWS", 10)
    model = fit_tree(sample(spark, 100), ARITIES, NAMES, FOREST_REGRESSOR)
    assert isinstance(model, RandomForestRegressionModel) and model.getNumTrees == 10


def test_thresholds_of_many_values():
    values, counts = np.arange(1000.0), np.ones(1000)
    assert list(grown.thresholds_of(np.array([3.0, 1.0, 1.0]), np.ones(3), 5)) == [2.0]
    assert list(grown.thresholds_of(values, counts, 4)) == [249.5, 499.5, 749.5]


def test_empty_bags_and_one_value(spark):
    rows = spark.createDataFrame([([2.0, 0.0], 1.0)] * 3, "features array<double>, label double")
    model = fit_tree(rows, {}, ["a", "b"], FOREST_REGRESSOR)
    score = score_rows(model, rows).first().score
    assert model.n_trees == 1 and score in (0.0, 1.0)
    assert model.spark_ml().transform(rows.withColumn("vector", array_to_vector("features"))).first().prediction == score
