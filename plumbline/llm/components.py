"""Connected components of a graph of links, as DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.session import written

from .common import lookup

#: Labels that one task writes; a round over a small graph is then a few small tasks.
ROWS_PER_FILE = 500_000
#: Links that one task unites at once (16 MB); a larger graph is labelled in rounds.
AT_ONCE = 1_000_000


def united(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of links and the least node that each of them reaches."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = place[: len(a)], place[len(a) :]
    label = np.arange(len(nodes))
    while (label[x] != label[y]).any():
        low, high = np.minimum(label[x], label[y]), np.maximum(label[x], label[y])
        np.minimum.at(label, high, low)  # every label is a root of its own here
        while (label[label] != label).any():
            label = label[label]
    return nodes, nodes[label]


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    links = [(batch.column("a").to_numpy(zero_copy_only=False), batch.column("b").to_numpy(zero_copy_only=False)) for batch in batches]
    if links:
        nodes, least = united(*(np.concatenate(ends) for ends in zip(*links, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(least)], names=["node", "component"])


def components(links: DataFrame) -> DataFrame:
    """The least node reachable from each node of the links (a, b): node, component. Pass what is written.

    Of a graph of at most AT_ONCE links one task takes all. Otherwise every round takes the least label among neighbours
    and then follows labels one step further, so that chains are halved; each round's labels are written to the shared
    folder. Nodes without links aren't listed. The links of a node that has many, and the members of a component that has
    many, are spread over tasks.
    """
    links = links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b")
    if links.count() <= AT_ONCE:
        return written(links.coalesce(1).mapInArrow(_united, "node long, component long"), "labels")
    edges = written(links.union(links.select("b", "a")).distinct(), "links")
    parts = max(1, -(-edges.count() // ROWS_PER_FILE))  # labels are no more than edges
    start = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near"), F.count(F.lit(1)).alias("degree"))
    labels = written(start.select("node", F.least("node", "near").alias("component"), "degree").coalesce(parts), "labels")
    degrees = labels.select(F.col("node").alias("b"), "degree")
    while True:
        seen = labels.select(F.col("node").alias("b"), "component", "degree")
        least = lookup(edges, seen, ["b"], "degree", by="a", sizes=degrees).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        closer = labels.join(least, "node").select("node", "degree", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        step = written(closer.coalesce(parts), "labels")
        held = step.groupBy("component").agg(F.count(F.lit(1)).alias("members"))
        further = written(held.join(step.select(F.col("node").alias("component"), F.col("component").alias("beyond")), "component").coalesce(parts), "jumps")
        jumped = lookup(step, further, ["component"], "members", by="node").select("node", "degree", "old", F.least("component", "beyond").alias("component"))
        step = written(jumped.coalesce(parts), "labels")
        labels = step.select("node", "component", "degree")
        if step.where("old <> component").isEmpty():
            return labels.select("node", "component")
