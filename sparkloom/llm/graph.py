"""Connected components of links, without collecting them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(links: DataFrame) -> DataFrame:
    """(node, comp) for each node of links (a, b); comp is the smallest node of the component.

    Smallest labels pass along links and then along labels (pointer jumping); every round is two aggregations with
    partial sums, so a node may have any number of links. Rounds end when no label changes.
    """
    both = materialize(links.select("a", "b").unionByName(links.selectExpr("b AS a", "a AS b")).distinct(), "links")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("comp")), "labels")
    while True:
        offered = both.join(labels, F.col("a") == F.col("node")).groupBy("b").agg(F.min("comp").alias("offer"))
        after = labels.join(offered, F.col("node") == F.col("b"), "left").select("node", "comp", F.least("comp", "offer").alias("low"))
        jump = after.select(F.col("node").alias("at"), F.col("low").alias("lower"))
        after = after.join(jump, F.col("low") == F.col("at"), "left").select("node", F.col("comp").alias("old"), F.least("low", "lower").alias("comp"))
        after = materialize(after, "labels")
        changed = after.where(F.col("old") != F.col("comp")).limit(1).count()
        labels = after.select("node", "comp")
        if not changed:
            return labels


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels (node, comp) after further links (a, b) between their nodes."""
    la, lb = labels.selectExpr("node AS a", "comp AS ca"), labels.selectExpr("node AS b", "comp AS cb")
    between = links.select("a", "b").join(la, "a").join(lb, "b").where("ca <> cb").selectExpr("ca AS a", "cb AS b")
    moved = components(between).selectExpr("node AS comp", "comp AS lower")
    return materialize(labels.join(moved, "comp", "left").select("node", F.coalesce("lower", "comp").alias("comp")), "labels")
