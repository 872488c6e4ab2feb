"""Connected components by alternating large-star and small-star steps, all distributed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import checkpoint

#: Edges, 16 bytes each, up to which one task finishes the graph.
LOCAL_EDGES = 1_000_000


def least_labels(linked: np.ndarray) -> np.ndarray:
    """Least node of each node's component, from a square boolean matrix of links."""
    label = np.arange(len(linked))
    while True:
        least = np.minimum(label, np.where(linked, label[None, :], len(linked)).min(1, initial=len(linked)))
        least = least[least]
        if (least == label).all():
            return label
        label = least


def edge_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least node of each node's component, from edges between the nodes that `label` numbers."""
    while True:
        least = label.copy()
        np.minimum.at(least, a, label[b])
        np.minimum.at(least, b, label[a])
        # The component's present root learns of the lesser one as well.
        np.minimum.at(least, label, least.copy())
        least = least[least]
        if (least == label).all():
            return label
        label = least


def _large_star(edges: DataFrame) -> DataFrame:
    """Every greater neighbour of a node is tied to the least of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the least of those."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    return edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tie every node of one task's edges to the least id of its component."""
    parts = [(b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)) for b in batches]
    if not parts:
        return
    ids, of = np.unique(np.concatenate([x for p in parts for x in p]), return_inverse=True)
    splits = np.cumsum([len(x) for p in parts for x in p])[:-1]
    ends = np.split(of, splits)
    a, b = np.concatenate(ends[0::2]), np.concatenate(ends[1::2])
    label = edge_labels(np.arange(len(ids)), a, b)
    moved = np.flatnonzero(label != np.arange(len(ids)))
    yield pa.RecordBatch.from_arrays([pa.array(ids[moved]), pa.array(ids[label[moved]])], names=["a", "b"])


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) of every node on an edge (a, b) of whole numbers; component is the least id reachable.

    Each round is written by checkpoint, so lineage stays short and a lost executor costs one round.
    The rounds grow with the logarithm of the longest path. No node's neighbours are gathered.
    A graph of at most LOCAL_EDGES edges, counted first, is finished in one task of tens of MB instead.
    """
    edges = checkpoint(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if before is None and 0 < state[0] <= LOCAL_EDGES:
            kind = edges.schema["a"].dataType.simpleString()
            edges = checkpoint(edges.coalesce(1).mapInArrow(_finish, f"a {kind}, b {kind}"))
            break
        if state == before or not state[0]:
            break
        before = state
        edges = checkpoint(_small_star(_large_star(edges)))
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
