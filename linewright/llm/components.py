"""Connected components of links, by alternating large-star and small-star rounds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linewright.llm.common import cut


def connected(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges (a, b), component being the least node reachable.

    Each round hangs every node's neighbours on the least node known near it, until nothing
    changes; the number of rounds grows with the logarithm of a component's size. Nothing but
    two sums of each round reaches the driver. Loops and repeated edges do no harm, an edge
    with a null end is none, and no edges give no rows.
    """
    links = edges.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct()
    links = cut(links)
    seen = None
    for _ in range(rounds):
        # large star: every larger neighbour of a node goes to the node's least neighbour
        both = links.select(F.col("lo").alias("u"), F.col("hi").alias("v")).union(links.select("hi", "lo"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("m").alias("lo"), F.col("v").alias("hi")).distinct()
        # small star: every smaller neighbour of a node, and the node, go to its least neighbour
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi")
        small = small.select(F.col("m").alias("lo"), F.explode(F.array("hi", "lo")).alias("hi")).where(F.col("lo") != F.col("hi")).distinct()
        links = cut(small)
        now = links.agg(F.count("*"), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"the components weren't found in {rounds} rounds")
    return links.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(links.select("lo", "lo").distinct())


#: A class of more than this share of all rows is joined by broadcast: there are fewer than
#: 1 / HOT_SHARE of them.
HOT_SHARE = 1e-4


def named_components(members: DataFrame, classes: DataFrame, links: DataFrame, edges: DataFrame) -> DataFrame:
    """class_id, n_links, component_id and group for each of members (name and others, which stay).

    classes: (name, node, rep, copies): what members know a class by, its number, its least id
    and how many members it has. links: (a, links) counts a class's linked documents outside
    it. edges: (a, b) join linked classes. A component is named by the least id in it, which
    is null if all its ids are; group tells it apart from others in any case.
    """
    roots = connected(edges)
    placed = classes.select("name", "node", "rep", "copies").join(roots.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n"), "left").drop("_n")
    names = placed.where(F.col("component").isNotNull()).groupBy("component").agg(F.min("rep").alias("least"))
    about = placed.join(names, "component", "left").join(links, F.col("node") == F.col("a"), "left")
    about = about.select(
        "name", "copies", F.col("rep").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("least", "rep").alias("component_id"), F.coalesce("component", "node").alias("group"),
    )
    about = cut(about)
    # the members of a large class don't all meet in one task
    hot = F.col("copies") > max(1000.0, HOT_SHARE * (about.agg(F.sum("copies")).first()[0] or 0))
    large = about.where(hot).drop("copies")
    if large.isEmpty():
        return members.join(about.drop("copies"), "name").drop("name")
    rest = members.join(F.broadcast(large.select("name")), "name", "left_anti").join(about.where(~hot).drop("copies"), "name")
    return rest.unionByName(members.join(F.broadcast(large), "name")).drop("name")


class Forest:
    """What joins n nodes, kept up as links come in: no more than an edge for each node."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def join(self, left: np.ndarray, right: np.ndarray) -> None:
        """Link the nodes left[i] and right[i]."""
        parent = self.parent
        left, right = parent[left], parent[right]
        while True:
            open_ = left != right
            left, right = left[open_], right[open_]
            if not len(left):
                return
            # hang the larger root of each pair on the least root that a pair leads it to
            np.minimum.at(parent, np.maximum(left, right), np.minimum(left, right))
            while (parent != parent[parent]).any():
                parent[:] = parent[parent]
            left, right = parent[left], parent[right]

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        hung = np.flatnonzero(self.parent != np.arange(len(self.parent)))
        return self.parent[hung], hung


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join the same nodes as the pairs (a, b) do, fewer than there are nodes."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    tree = Forest(len(nodes))
    tree.join(ends[: len(a)], ends[len(a) :])
    low, high = tree.edges()
    return nodes[low], nodes[high]
