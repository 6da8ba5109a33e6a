"""Connected components of a link table, by contraction.

Each round every node points to its smallest neighbour (an aggregation that combines
before the shuffle), pointers are followed to their roots, and links are moved to the
roots: those within one root go, and equal ones become one.  A node that nothing points
to has a smaller root next to it, so two rounds at least halve what is left.  Only links
and labels move; every round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def _moved(links: DataFrame, labels: DataFrame) -> DataFrame:
    """Links between the labels of their ends, those that still join two."""
    a, b = labels.toDF("a", "label_a"), labels.toDF("b", "label_b")
    x, y = F.coalesce("label_a", "a"), F.coalesce("label_b", "b")
    return links.join(a, "a", "left").join(b, "b", "left").select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).where("a <> b").distinct()


def _roots(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """node, label of all nodes: the end of the way along smallest neighbours."""
    both = links.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("other")))
    up = scratch.write(both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("label")), f"{name}_0")
    k = 0
    while True:
        jump = up.toDF("label", "further")
        new = scratch.write(up.join(jump, "label").select("node", F.col("further").alias("label"), F.col("label").alias("old")), f"{name}_{k + 1}")
        changed = new.where("label <> old").limit(1).count()
        scratch.drop(f"{name}_{k}")
        up, k = new.select("node", "label"), k + 1
        if not changed:
            return up


def components(links: DataFrame, scratch: Scratch, name: str, known: DataFrame | None = None) -> DataFrame:
    """node, label (smallest node of the component) for all nodes that have a link (a, b).

    ``known`` has the components of earlier links, which ``links`` add to.
    """
    nodes = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    labels = nodes.select("node", F.col("node").alias("label"))
    if known is not None:
        labels = known.unionByName(labels.join(known.select("node"), "node", "left_anti"))
        links = _moved(links, known)
    labels = scratch.write(labels, f"{name}_labels0")
    left = scratch.write(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), f"{name}_links0")
    k = 0
    while left.limit(1).count():
        roots = _roots(left, scratch, f"{name}_up{k}")
        moved = scratch.write(_moved(left, roots), f"{name}_links{k + 1}")
        new = labels.join(roots.toDF("label", "root"), "label", "left").select("node", F.coalesce("root", "label").alias("label"))
        new = scratch.write(new, f"{name}_labels{k + 1}")
        scratch.drop(f"{name}_links{k}")
        scratch.drop(f"{name}_labels{k}")
        left, labels, k = moved, new, k + 1
    return labels
