"""Connected components of an edge table: contraction inside tasks, then label propagation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandel.kernels.raster import least_of_parts
from strandel.llm.common import cut_small

#: Edges that one task contracts by itself.
EDGES_A_TASK = 200_000


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One partition's edges contracted: each node with the smallest node of its part."""
    parts = [np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()], 1) for b in batches]
    edges = np.concatenate(parts) if parts else np.zeros((0, 2), np.int64)
    nodes, at = np.unique(edges, return_inverse=True)
    at = at.reshape(-1, 2)
    yield pa.record_batch([pa.array(nodes), pa.array(nodes[least_of_parts(len(nodes), at[:, 0], at[:, 1])])], names=["a", "b"])


def components(edges: DataFrame, n: int, most_rounds: int = 200) -> DataFrame:
    """node, component (the smallest node reachable) of every node of the `n` `edges` (a, b: long, a <> b).

    Each task contracts its own edges, a bounded number, into stars. Where one task holds all, that is
    the result. Else each round takes the smallest label among a node and its neighbours (combined
    map-side, so a hub is not gathered), then follows labels of labels, which halves what is left of
    long chains. Rounds are cut by a checkpoint. Running out of rounds raises.
    """
    parts = max(1, -(-n // EDGES_A_TASK))
    stars = cut_small(edges.select("a", "b").coalesce(parts).mapInArrow(_stars, "a long, b long"), EDGES_A_TASK, parts)
    if parts == 1:
        return stars.select(F.col("a").alias("node"), F.col("b").alias("component"))
    both = cut_small(stars.union(stars.select("b", "a")).filter("a <> b").distinct(), parts=parts)
    labels = cut_small(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("component")), parts=parts)
    for _ in range(most_rounds):
        near = both.join(labels, both.b == labels.node).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        stepped = labels.join(near, "node", "left").select("node", "component", F.least("component", F.coalesce("near", "component")).alias("step"))
        roots = stepped.select(F.col("node").alias("root"), F.col("step").alias("jump"))
        moved = cut_small(stepped.join(roots, F.col("step") == F.col("root"), "left").select("node", F.col("component").alias("old"), F.least("step", F.coalesce("jump", "step")).alias("component")), parts=parts)
        labels = moved.select("node", "component")
        if moved.filter("old <> component").isEmpty():
            return labels
    raise RuntimeError("components did not settle")
