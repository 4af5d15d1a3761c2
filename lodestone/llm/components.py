"""Connected components of links, as DataFrames."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import Workspace, ship

#: Links that one task merges, and that one file of an intermediate table holds.
LINKS_A_FILE = 200_000


def union(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the groups of a[k] and b[k]; every node's label is the smallest node of its group."""
    while True:
        x, y = label[a], label[b]
        differ = x != y
        if not differ.any():
            return
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label != label[label]).any():
            label[:] = label[label]


def _merged(batches):
    """The links of one task as stars around the smallest node of each group, merged every LINKS_A_FILE links."""
    held, size = [], 0

    def stars() -> np.ndarray:
        pairs = np.concatenate(held) if held else np.zeros((0, 2), np.int64)
        nodes, at = np.unique(pairs, return_inverse=True)
        at = at.reshape(-1, 2)
        label = np.arange(len(nodes))
        union(label, at[:, 0], at[:, 1])
        moved = np.flatnonzero(label != np.arange(len(nodes)))
        return np.stack([nodes[moved], nodes[label[moved]]], 1)

    for b in batches:
        held.append(np.stack([b.column(c).to_numpy() for c in (0, 1)], 1))
        size += b.num_rows
        if size >= LINKS_A_FILE:
            held = [stars()]
            size = 0
    out = stars()
    yield pa.RecordBatch.from_arrays([pa.array(out[:, 0], pa.int64()), pa.array(out[:, 1], pa.int64())], ["u", "v"])


def components(links: DataFrame, space: Workspace) -> DataFrame:
    """(node, component): the smallest node that can be reached, for nodes of `links` (a, b).

    Each task first merges its own links to stars, LINKS_A_FILE of them at a time; where there is
    only one task, that is all. Otherwise large-star and small-star steps alternate until the
    links are stars around their smallest nodes. Neighbour minima are aggregated before the
    shuffle and joined back, so that a hub's links are never collected; the state after each step
    is a table in the shared folder.
    """
    ship(links.sparkSession)
    files = 1 + links.count() // LINKS_A_FILE
    local = lambda df: df.coalesce(files).mapInArrow(_merged, "u long, v long")
    edges = space.save(local(links.select("a", "b").where("a <> b")), "edges")
    while files > 1:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low.select("u", F.col("m").alias("v"))).distinct()
        following = space.save(small.coalesce(files), "edges")  # a star step never makes more links than it reads
        state = lambda df: df.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        same = state(following) == state(edges)
        space.drop(edges)
        edges = following
        if same:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
