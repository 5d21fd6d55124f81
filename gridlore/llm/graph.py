"""Connected components of a link table by alternating stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gridlore.llm.common import materialise


def contract(links: DataFrame) -> DataFrame:
    """Replace the links of each Arrow batch by stars around their smallest nodes; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.asarray(batch.column(c)) for c in ("a", "b"))
            nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
            left, right = flat[: len(a)], flat[len(a) :]
            root = np.arange(len(nodes))
            while True:  # smallest label over links, then pointer jumping
                low = np.minimum(root[left], root[right])
                before = root.copy()
                np.minimum.at(root, root[left], low)
                np.minimum.at(root, root[right], low)
                np.minimum.at(root, left, low)
                np.minimum.at(root, right, low)
                root = root[root]
                if np.array_equal(root, before):
                    break
            own = root != np.arange(len(nodes))
            yield pa.RecordBatch.from_pydict({"a": nodes[own], "b": nodes[root[own]]})

    return links.select("a", "b").mapInArrow(run, "a long, b long")


def star(links: DataFrame, large: bool) -> DataFrame:
    """Link the neighbours of each node to the smallest of them.

    Large stars relink the neighbours above a node, small stars those below it.
    """
    both = links.union(links.select("b", "a")).toDF("u", "v") if large else links.toDF("u", "v")
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = both.join(least, "u")
    if large:
        out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select("u", "m"))
    return out.where("a <> b").distinct()


def connected_components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node that each linked node can reach.

    links has long columns a and b; self links, repeated and null links are ignored.  Nodes
    without a link are not in the result.  Alternating large and small stars converges in a
    number of rounds that grows with the logarithm of the longest path.
    """
    oriented = links.where("a is not null and b is not null and a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    )
    now = materialise(contract(oriented).distinct())
    seen = None
    for _ in range(rounds):
        mark = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if (mark.n, mark.x) == seen or not mark.n:
            return now.toDF("node", "root").union(now.select("b", "b").distinct())
        seen = (mark.n, mark.x)
        now = materialise(star(star(now, True), False))
    raise RuntimeError(f"components have not converged in {rounds} rounds")
