"""Connected components by hooking to the smallest neighbour and pointer jumping: of a graph given by its edges, and of the
few thousand nodes that one task holds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwatch.functions.stored import store
from shelfwatch.llm.common import in_few_files


MANY = 1000  # a component with more than one in so many of all members is large; there are fewer of them


def smallest_reachable(linked: np.ndarray) -> np.ndarray:
    """From a symmetric matrix of links: the smallest row number that each row reaches."""
    n = len(linked)
    root = np.arange(n)
    while True:
        lower = root.copy()
        for start in range(0, n, 256):
            rows = slice(start, start + 256)
            lower[rows] = np.minimum(lower[rows], np.where(linked[rows], root, n).min(1, initial=n))
        lower = lower[lower]
        if (lower == root).all():
            return root
        root = lower


def components(edges: DataFrame) -> DataFrame:
    """From edges (a, b) in any direction: node, component (the smallest node reachable), for nodes with an edge to another.

    Every round replaces each node's label by the smallest among its own and its neighbours' labels and then by that
    label's label, so chains shorten at least by half. Only (node, label) pairs are shuffled; nothing is collected.
    """
    edges = edges.filter("a <> b").select("a", "b")
    edges = store(in_few_files(edges.union(edges.select("b", "a")).distinct(), "a"), "edges")
    labels = store(in_few_files(
        edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "node"), "labels")
    while True:
        of_neighbour = labels.select(F.col("node").alias("b"), F.col("label").alias("other"))
        near = edges.join(of_neighbour, "b").groupBy(F.col("a").alias("node")).agg(F.min("other").alias("near"))
        hooked = labels.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        further = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        jumped = store(in_few_files(
            hooked.join(further, "label").select("node", "was", F.least("label", "further").alias("label")), "node"), "labels")
        if not jumped.filter("label <> was").head(1):
            return jumped.select("node", F.col("label").alias("component"))
        labels = jumped.select("node", "label")


def with_first(members: DataFrame) -> DataFrame:
    """Add ``component_first``, the smallest ``first`` of the component, to members (component, first, further columns).

    Members of large components look it up in a broadcast of fewer than ``MANY`` rows and are not shuffled, so none of them
    fills a task; the others are joined. The table is written first, as it is read three times.
    """
    members = store(members, "component_members")
    total = members.count()
    firsts = store(members.groupBy("component").agg(F.min("first").alias("component_first"), F.count("*").alias("members")), "firsts")
    large = F.col("members") * MANY > total
    known = members.join(F.broadcast(firsts.filter(large).drop("members")), "component", "left")
    others = known.filter("component_first IS NULL").drop("component_first")
    return known.filter("component_first IS NOT NULL").unionByName(
        others.join(firsts.filter(~large).drop("members"), "component"))
