"""Tree models as data: many apps' trees scored inside one plan.

Spark ML saves a tree model as a table of nodes (id in preorder, prediction, class
counts, children, split feature with its threshold or left categories); a forest adds
the tree's number. All modelled apps' node tables are read in one scan, each tree
becomes one array of nodes indexed by id, and each app one row of trees joined to its
requests on app_id. A tree is walked by ``aggregate`` over a fixed number of steps (its
model's maxDepth): a step moves from an inner node to a child and stays on a leaf. A
forest averages its trees, as Spark ML does for regressors and, with class counts made
chances per tree, for classifiers.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Spark ML's largest tree depth, and its saved tree and forest model classes.
MOST_STEPS = 30
CLASSIFIERS = ("tree_classifier", "forest_classifier")
FORESTS = ("forest_regressor", "forest_classifier")
TREE_KINDS = ("tree_regressor", "tree_classifier", "forest_regressor", "forest_classifier")
NODE = "struct<f:int,t:array<double>,cont:boolean,l:int,r:int,v:double>"


def qualified(spark: SparkSession, path: str) -> str:
    """A folder as the file system names it, as readers report the paths of their files."""
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.makeQualified(hadoop_path).toString().rstrip("/")


def _owner(column: str, tail: str) -> Column:
    """The model folder of a file read below ``<folder>/model/<tail>``."""
    return F.regexp_extract(F.col("_metadata.file_path"), rf"^(.*)/model/{tail}/[^/]+$", 1)


def _node(value: Column) -> Column:
    split = F.col("node.split")
    return F.struct(
        split["featureIndex"].alias("f"),
        split["leftCategoriesOrThreshold"].alias("t"),
        (split["numCategories"] < 0).alias("cont"),
        F.col("node.leftChild").alias("l"),
        F.col("node.rightChild").alias("r"),
        value.cast("double").alias("v"),
    )


def _leaf_value(classifier: bool) -> Column:
    """What a leaf gives: the prediction, or for a classifier the share of class 1 in its counts."""
    if not classifier:
        return F.col("node.prediction")
    counts = F.col("node.impurityStats")
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    return F.when(total > 0, F.coalesce(F.try_element_at(counts, F.lit(2)), F.lit(0.0)) / total)


def node_tables(spark: SparkSession, saved: Iterable[tuple[str, str, str]]) -> DataFrame:
    """One row per app: app_id, ``trees`` (array of node arrays), ``steps`` (its maxDepth).

    ``saved`` holds (app_id, folder, model_type) of models written by ``save_model``;
    every kind of TREE_KINDS. Files of one kind are read in one scan, whatever the apps.
    """
    saved = list(saved)
    unknown = sorted({kind for _, _, kind in saved if kind not in TREE_KINDS})
    if unknown:
        raise ValueError(f"models of kinds {unknown} are not tree tables")
    owners = spark.createDataFrame(
        [(app, qualified(spark, folder), kind) for app, folder, kind in saved],
        "app_id string, folder string, model_type string",
    )
    parts = []
    for classifier in (False, True):
        for forest in (False, True):
            kinds = [k for k in TREE_KINDS if (k in CLASSIFIERS) == classifier and (k in FORESTS) == forest]
            folders = [f"{folder}/model/data" for _, folder, kind in saved if kind in kinds]
            if not folders:
                continue
            read = spark.read.parquet(*folders)
            nodes = (
                read.select(F.col("treeID").alias("tree"), F.col("nodeData").alias("node"), _owner("_", "data").alias("folder"))
                if forest
                else read.select(F.lit(0).alias("tree"), F.struct(*read.columns).alias("node"), _owner("_", "data").alias("folder"))
            )
            parts.append(nodes.select("folder", "tree", F.col("node.id").alias("id"), _node(_leaf_value(classifier)).alias("n")))
    nodes = parts[0]
    for more in parts[1:]:
        nodes = nodes.unionByName(more)
    trees = (
        nodes.groupBy("folder", "tree")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "n"))), lambda x: x["n"]).alias("nodes"))
        .groupBy("folder")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("tree", "nodes"))), lambda x: x["nodes"]).alias("trees"))
    )
    meta = spark.read.json([f"{folder}/model/metadata" for _, folder, _ in saved])
    depth = [f"{m}.maxDepth" for m in ("paramMap", "defaultParamMap") if _has(meta, m, "maxDepth")]
    steps = meta.select(
        _owner("_", "metadata").alias("folder"),
        F.least(F.coalesce(*[F.col(d) for d in depth], F.lit(MOST_STEPS)), F.lit(MOST_STEPS)).cast("int").alias("steps"),
    )
    return owners.join(trees, "folder").join(steps, "folder").select("app_id", "model_type", "trees", "steps")


def _has(df: DataFrame, struct: str, field: str) -> bool:
    kind = df.schema[struct].dataType if struct in df.columns else None
    return kind is not None and field in getattr(kind, "fieldNames", lambda: [])()


def walk(tree: Column, features: Column, steps: Column) -> Column:
    """The value of the leaf that ``features`` reach in ``tree``."""

    def step(at: Column, _: Column) -> Column:
        node = F.element_at(tree, at + 1)
        x = F.element_at(features, node["f"] + 1)
        left = F.when(node["cont"], x <= F.element_at(node["t"], 1)).otherwise(F.array_contains(node["t"], x))
        return F.when(node["l"] < 0, at).when(left, node["l"]).otherwise(node["r"])

    leaf = F.aggregate(F.sequence(F.lit(1), F.greatest(steps, F.lit(1))), F.lit(0), step)
    return F.element_at(tree, leaf + 1)["v"]


def forest_score(trees: Column, features: Column, steps: Column) -> Column:
    """The mean of the trees' leaf values: Spark ML's prediction, or its chance of class 1."""
    total = F.aggregate(trees, F.lit(0.0), lambda acc, t: acc + walk(t, features, steps))
    return total / F.size(trees)
