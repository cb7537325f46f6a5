"""Connected components of a link table, as repeated joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridpanel.session import materialize


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable over ``links`` (a, b).

    Only nodes with a link to another node are returned. Each round every node
    takes the smallest label around it, its whole tree follows (one minimum per
    label), and labels jump to their label's label; rounds grow with the logarithm
    of a component's diameter. Labels are written to the shared folder each round.
    A node's own links meet in one task, a component doesn't: minima are combined
    before the shuffle and label look-ups are plain joins that AQE may split.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = materialize(both.where("a <> b").distinct(), "edges")
    labels = materialize(edges.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("root")), "labels")
    while True:
        near = (
            edges.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("root").alias("near"))
        )
        grown = labels.join(near, F.col("node") == F.col("a")).select(
            "node", F.col("root").alias("old"), F.least("root", "near").alias("low")
        )
        hooks = grown.groupBy(F.col("old").alias("tree")).agg(F.min("low").alias("hook"))
        moved = grown.join(hooks, F.col("old") == F.col("tree")).select("node", "old", F.least("low", "hook").alias("root"))
        moved = materialize(moved, "moved")
        jump = moved.select(F.col("node").alias("at"), F.col("root").alias("next"))
        after = moved.join(jump, F.col("root") == F.col("at")).select("node", "old", F.least("root", "next").alias("root"))
        after = materialize(after, "labels")
        if after.where("old <> root").isEmpty():
            return after.select("node", "root")
        labels = after.select("node", "root")
