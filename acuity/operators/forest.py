"""The fitted forest as a table of nodes, and scores and importances read from that table.

A node is a row: its tree and number, the feature and threshold it asks (rows at or below the
threshold go left), its children, the gain of its split, the weight of the training rows that
reached it, and the share of class 1 among them. Leaves have no feature. The table holds
trees * 2^(depth + 1) rows at most, whatever the data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NODE_COLUMNS = [
    "tree", "node", "feature", "threshold", "left_node", "right_node", "gain", "weight", "share",
]


def stored_nodes(spark: SparkSession, stages: str, features: Sequence[str]) -> DataFrame:
    """The node table of a forest in a stored pipeline, with the names of its inputs."""
    saved = spark.read.parquet(f"{stages}/stages/*RandomForestClassifier*/data")
    n = F.col("nodeData")
    inner = n["leftChild"] >= 0
    total = F.aggregate(n["impurityStats"], F.lit(0.0), lambda a, x: a + x)
    names = F.array(*[F.lit(f) for f in features])
    return saved.select(
        F.col("treeID").alias("tree"), n["id"].alias("node"),
        F.when(inner, F.get(names, n["split"]["featureIndex"])).alias("feature"),
        F.when(inner, F.get(n["split"]["leftCategoriesOrThreshold"], F.lit(0))).alias("threshold"),
        F.when(inner, n["leftChild"]).alias("left_node"),
        F.when(inner, n["rightChild"]).alias("right_node"),
        F.when(inner, n["gain"]).alias("gain"),
        total.alias("weight"),
        (F.get(n["impurityStats"], F.lit(1)) / total).alias("share"),
    )


def importances(nodes: DataFrame) -> DataFrame:
    """``feature`` and ``importance`` of the features that are asked for.

    Gains, weighted by rows, as shares of their tree; the mean share of a feature over the
    trees that split at all.
    """
    used = nodes.filter("feature IS NOT NULL").groupBy("tree", "feature").agg(
        F.sum(F.col("gain") * F.col("weight")).alias("_gain"))
    trees = used.groupBy("tree").agg(F.sum("_gain").alias("_all"))
    shares = used.join(trees, "tree").groupBy("feature").agg(
        F.sum(F.col("_gain") / F.col("_all")).alias("_share"))
    whole = shares.agg(F.sum("_share").alias("_sum"))
    return shares.join(F.broadcast(whole)).select(
        "feature", (F.col("_share") / F.col("_sum")).alias("importance"))


def tree_texts(nodes: DataFrame, inputs: dict[str, str]) -> list[str]:
    """P(class 1) by each tree as SQL text, a nest of CASE over ``inputs``, a column per feature.

    Numbers are written with an exponent, which makes them doubles in any engine that reads
    the text.
    """
    number = "{:.17e}".format
    trees: dict[int, dict] = {}
    for row in nodes.collect():  # bounded by the model, not by the data
        trees.setdefault(row["tree"], {})[row["node"]] = row

    def text(tree: dict, node: int) -> str:
        row = tree[node]
        if row["feature"] is None:
            return number(row["share"])
        left, right = text(tree, row["left_node"]), text(tree, row["right_node"])
        return f"CASE WHEN {inputs[row['feature']]} <= {number(row['threshold'])} THEN {left} ELSE {right} END"

    return [text(tree, 0) for _, tree in sorted(trees.items())]


def score_column(nodes: DataFrame, inputs: dict[str, str]) -> Column:
    """The mean of the trees as one column of built-in functions."""
    each = [F.expr(t) for t in tree_texts(nodes, inputs)]
    return F.aggregate(F.array(*each), F.lit(0.0), lambda a, x: a + x) / len(each)


def walk_sql(rows: str, nodes: str, key: str, features: Sequence[str]) -> str:
    """SQL for another engine: ``key`` and ``risk_score``, by following the node table row by row."""
    listed = ", ".join(features)
    return f"""
WITH RECURSIVE long AS (UNPIVOT (SELECT {key}, {listed} FROM {rows}) ON {listed} INTO NAME feature VALUE value),
walk AS (
  SELECT r.{key}, n.* FROM {rows} r, {nodes} n WHERE n.node = 0
  UNION ALL
  SELECT w.{key}, n.* FROM walk w JOIN long l ON l.{key} = w.{key} AND l.feature = w.feature
    JOIN {nodes} n ON n.tree = w.tree
      AND n.node = CASE WHEN l.value <= w.threshold THEN w.left_node ELSE w.right_node END
)
SELECT {key}, avg(share) AS risk_score FROM walk WHERE feature IS NULL GROUP BY {key}"""
