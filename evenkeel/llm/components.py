"""Connected components of a link table, without collecting links, nodes or labels anywhere.

Each round hooks every root to its smallest smaller neighbour, follows hooks a few steps, relabels the links and drops
those inside a component. Links shrink to nothing; each round is a written table, so lost executors cost one round.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.llm.storage import remove, written

#: Times that pointers are doubled in a round: chains of up to 2**JUMPS hooks collapse at once.
JUMPS = 3


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of the same components as ``a``–``b``, one for each node that isn't its component's smallest."""
    nodes, both = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = both[: len(a)], both[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        np.minimum.at(label, label[x], low)
        np.minimum.at(label, label[y], low)
        while not np.array_equal(nearer := label[label], label):
            label = nearer
        if np.array_equal(label[x], label[y]):
            break
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those of the links that join the same components without loops: fewer than nodes, each as it was given."""
    nodes, both = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = both[: len(a)], both[len(a) :]
    label, chosen, open_ = np.arange(len(nodes)), [np.empty(0, np.int64)], np.flatnonzero(x != y)
    while len(open_):
        first = np.full(len(nodes), len(a))  # each component's first link to another one
        np.minimum.at(first, label[x[open_]], open_)
        np.minimum.at(first, label[y[open_]], open_)
        chosen.append(np.unique(first[first < len(a)]))
        moved, to = forest(label[x[chosen[-1]]], label[y[chosen[-1]]])
        ahead = np.arange(len(nodes))
        ahead[moved] = to
        label = ahead[label]
        open_ = open_[label[x[open_]] != label[y[open_]]]
    chosen = np.concatenate(chosen)
    return a[chosen], b[chosen]


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links (a, b)``; root is the smallest node of its component.

    Loops, repeated links and links with a null end are allowed; a null end links nothing.
    """
    spark = links.sparkSession
    links = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a is not null and b is not null and a <> b").distinct()
    links, links_path = written(links, "links")
    roots = links.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("root", F.col("node"))
    roots_path = None
    while not links.isEmpty():
        hooks = links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
        for _ in range(JUMPS):
            ahead = hooks.select(F.col("node").alias("root"), F.col("root").alias("further"))
            hooks = hooks.join(ahead, "root", "left").select("node", F.coalesce("further", "root").alias("root"))
        hooks, hooks_path = written(hooks, "hooks")
        step = lambda df, column: (
            df.withColumnRenamed(column, "_at")
            .join(hooks.select(F.col("node").alias("_at"), F.col("root").alias("_to")), "_at", "left")
            .withColumn(column, F.coalesce("_to", "_at"))
            .drop("_at", "_to")
        )
        new_roots, new_roots_path = written(step(roots, "root").select("node", "root"), "roots")
        left = step(step(links, "a"), "b").where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        new_links, new_links_path = written(left, "links")
        remove(spark, links_path, hooks_path, *([roots_path] if roots_path else []))
        links, links_path, roots, roots_path = new_links, new_links_path, new_roots, new_roots_path
    return roots
