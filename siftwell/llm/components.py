"""Connected components by contraction; everything stays in tables in the shared folder."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import freeing, stash, unstash

#: Edges of a contracted graph that one task takes at most (16 bytes each); larger graphs are contracted further.
SMALL = 1 << 18


def _pairs(edges: DataFrame, a: str, b: str) -> DataFrame:
    return edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).filter("hi <> lo").distinct()


def smallest_nodes(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) of the edges a - b."""
    ids, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(ids))
    while True:
        low = np.minimum(root[x], root[y])
        before = root.copy()
        # the roots of both ends learn of the smaller one, then all pointers are followed to their end
        np.minimum.at(root, before[x], low)
        np.minimum.at(root, before[y], low)
        while (further := root[root]).tobytes() != root.tobytes():
            root = further
        if (root == before).all():
            return ids, ids[root]


def _finished(live: DataFrame) -> DataFrame:
    """(id, to) of a graph of at most ``SMALL`` edges, in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches]
        if got:
            ids, least = smallest_nodes(*(np.concatenate(x) for x in zip(*got, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(least, pa.int64())], names=["id", "to"])

    return live.select("hi", "lo").coalesce(1).mapInArrow(freeing(run), "id long, to long")


def connected_components(edges: DataFrame, small: int = SMALL) -> DataFrame:
    """(id, component) of each node of ``edges`` (src, dst longs); component is its smallest node.

    Each round points every node at its smallest neighbour, takes two steps along the pointers and
    contracts the edges, so nodes that are not yet roots at least halve and rounds grow with the logarithm of the longest
    path.  Joins read stored tables on both sides, so that AQE can split a hub's rows; minima are
    pre-aggregated.  What is left at ``small`` edges or fewer is finished in one task.  Self-loops, repeats and null ends
    are ignored; no edges give no rows.
    """
    live = stash(_pairs(edges.filter("src is not null and dst is not null"), "src", "dst"), "edges")
    total = None
    while n := live.count():
        last = n <= small
        if last:
            jump = stash(_finished(live), "roots")
        else:
            near = live.select(F.col("hi").alias("id"), F.col("lo").alias("to")).unionByName(
                live.select(F.col("lo").alias("id"), F.col("hi").alias("to")))
            step = stash(near.groupBy("id").agg(F.min("to").alias("to")).select("id", F.least("id", "to").alias("to")), "pointers")
            jump = step.alias("a").join(step.alias("b"), F.col("a.to") == F.col("b.id")).select("a.id", F.col("b.to").alias("to"))
            jump = stash(jump, "roots")
            unstash(step)
            old, live = live, stash(_pairs(
                live.join(jump.select(F.col("id").alias("hi"), F.col("to").alias("x")), "hi")
                .join(jump.select(F.col("id").alias("lo"), F.col("to").alias("y")), "lo"), "x", "y"), "edges")
            unstash(old)
        if total is None:
            total = jump
        else:
            done = total.join(jump.select(F.col("id").alias("to"), F.col("to").alias("z")), "to", "left")
            old, total = total, stash(done.select("id", F.coalesce("z", "to").alias("to")), "labels")
            unstash(old), unstash(jump)
        if last:
            break
    unstash(live)
    if total is None:
        return edges.sparkSession.createDataFrame([], "id long, component long")
    # a pointer may end one contraction short of its root only while edges remain
    return total.withColumnRenamed("to", "component")
