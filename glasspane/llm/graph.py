"""Connected components of a graph of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C


def components(links: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) of every node in the links (a, b).

    Each round takes the smallest label of a node and its neighbours, and then the label of that label, so chains shorten quickly.
    Only links and labels move, with partial aggregation; nothing is collected but the number of changed labels. A table without
    links gives no rows.
    """
    both = F.expr("explode(array(struct(a, b), struct(b AS a, a AS b), struct(a, a AS b), struct(b AS a, b)))")
    near = C.durable(links.where("a <> b").select(both.alias("end")).select("end.*").distinct())
    parts = C.parts(near.count())  # there are no more nodes than rows here
    near = near.coalesce(parts)
    label = near.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root"))
    while True:
        told = near.join(label.select(F.col("node").alias("a"), "root"), "a").groupBy(F.col("b").alias("node")).agg(
            F.min("root").alias("via"), F.max(F.when(F.col("a") == F.col("b"), F.col("root"))).alias("was"))
        jump = label.select(F.col("node").alias("via"), F.col("root").alias("beyond"))
        new = C.durable(told.join(jump, "via").select("node", F.least("via", "beyond").alias("root"), (F.col("was") != F.col("via")).alias("changed"))).coalesce(parts)
        if not new.agg(F.count_if("changed")).first()[0]:
            return new.select("node", "root")
        label = new.select("node", "root")


def merged(root: DataFrame, links: DataFrame) -> DataFrame:
    """The components (node, root) after more links (a, b): only links between different components are followed.

    Both ends of any other link are in `root` already, so where there is no such link the components stay as they are.
    """
    for k in "ab":
        known = root.select(F.col("node").alias(k), F.col("root").alias(f"root_{k}"))
        links = links.join(known, k, "left").withColumn(f"root_{k}", F.coalesce(f"root_{k}", k))
    links = C.durable(links.where("root_a <> root_b"))
    n = links.count()
    if not n:
        return root
    links = links.coalesce(C.parts(n))
    joined = components(links.select(F.col("root_a").alias("a"), F.col("root_b").alias("b")))
    nodes = root.union(links.select("a", "root_a")).union(links.select("b", "root_b")).distinct()
    to = joined.select(F.col("node").alias("root"), F.col("root").alias("to"))
    return C.packed(nodes.join(to, "root", "left").select("node", F.coalesce("to", "root").alias("root")))
