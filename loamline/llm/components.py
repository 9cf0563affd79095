"""Connected components of a link table, by minimum labels and pointer jumping."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamline.llm.storage import discard, materialise

#: Links up to which one task finds the components; more of them go by rounds over the cluster.
AT_ONCE = 500_000


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links with the same components as u-v, but one per node: (node, smallest node of its component)."""
    if not len(u):
        return u, v
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    out = label != np.arange(len(nodes))
    return nodes[out], nodes[label[out]]


def _by_one_task(links: DataFrame, name: str) -> DataFrame:
    """Components of a few links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u, v = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:
            u, v = forest(*(np.concatenate([x, batch.column(c).to_numpy()]) for x, c in ((u, "u"), (v, "v"))))
        low = np.unique(v)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in ((u, low), (v, low))], names=["node", "label"])

    return materialise(links.coalesce(1).mapInArrow(run, "node long, label long"), f"{name}-labels")


def connected_components(links: DataFrame, name: str = "components", at_once: int = AT_ONCE) -> DataFrame:
    """Smallest node that each linked node reaches.

    In: ``u``, ``v`` longs without nulls, in any order, repeats allowed. Out:
    ``node``, ``label`` for every node that has a link to another; an empty
    table for none. Nothing is gathered on the driver. Up to ``at_once`` links
    are one task's work: the plans of the rounds would cost the driver far more
    than these rows cost a worker. Beyond that a join key may be a hub; both
    sides of each join are exchanged, so adaptive execution can split it.
    """
    links = materialise(links.where("u <> v").select("u", "v"), f"{name}-links", few=True)
    if links.count() <= at_once:
        return _by_one_task(links, name)
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    edges = materialise(both, f"{name}-edges", few=True)
    labels = materialise(edges.groupBy("u").agg(F.min("v").alias("low")).select(F.col("u").alias("node"), F.least("u", "low").alias("label")), f"{name}-labels", few=True)
    while True:
        heard = edges.join(labels, edges.u == labels.node).groupBy("v").agg(F.min("label").alias("heard"))
        # A node's old label hears of the node's new one as well, so chains shrink from both ends.
        near = labels.join(heard, labels.node == heard.v).select("node", "label", F.least("label", "heard").alias("new"))
        near = materialise(near, f"{name}-near", few=True)
        told = near.where("new < label").groupBy(F.col("label").alias("root")).agg(F.min("new").alias("told"))
        hop = near.join(told, near.label == told.root, "left").select("node", F.col("label").alias("old"), F.least("new", "told").alias("label"))
        after = materialise(hop, f"{name}-hop", few=True)
        done = after.where("old <> label").isEmpty()
        for old in (near, labels):
            discard(old)
        labels = after
        if done:
            return labels.select("node", "label")
