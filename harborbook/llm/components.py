"""Connected components of links between integers, by hooking to the smallest neighbour and pointer jumping."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harborbook.llm.tables import drop, written

#: So many links are put together at once in a task.
LINKS = 1_000_000


def _star(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """Links (a, b) as one link between every node and the smallest one it reaches through them."""
    names, places = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = places[: len(a)], places[len(a) :]
    label = np.arange(len(names))
    while len(x):
        x, y = label[x], label[y]
        x, y = np.minimum(x, y)[x != y], np.maximum(x, y)[x != y]
        np.minimum.at(label, y, x)
        while (label[label] != label).any():
            label = label[label]
    moved = label != np.arange(len(names))
    return pa.RecordBatch.from_arrays([pa.array(names[label[moved]]), pa.array(names[moved])], names=["a", "b"])


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for batch in batches:
        held.append([batch.column(c).to_numpy() for c in ("a", "b")])
        size += batch.num_rows
        if size >= LINKS:
            yield _star(*map(np.concatenate, zip(*held, strict=True)))
            held, size = [], 0
    if held:
        yield _star(*map(np.concatenate, zip(*held, strict=True)))


def _fewer(links: DataFrame) -> DataFrame:
    """Links (a < b) that make the same components, fewer where those of a task make rings or repeat each other."""
    return links.select("a", "b").where("a != b").mapInArrow(_stars, "a bigint, b bigint")


def _through(edges: DataFrame, parents: DataFrame) -> DataFrame:
    """Edges between parents."""
    a = parents.select(F.col("node").alias("a"), F.col("parent").alias("pa"))
    b = parents.select(F.col("node").alias("b"), F.col("parent").alias("pb"))
    moved = edges.join(a, "a", "left").join(b, "b", "left")
    return moved.select(F.coalesce("pa", "a").alias("a"), F.coalesce("pb", "b").alias("b"))


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node that each node of ``links`` (a, b) reaches.

    Every round halves the components that still have links, so their number grows with the logarithm of the input.
    """
    edges, labels = written(_fewer(links), "links"), None
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("parent"))
        parents = written(low.select("node", F.least("node", "parent").alias("parent")), "parents")
        was = parents
        while True:
            above = parents.select(F.col("node").alias("parent"), F.col("parent").alias("top"))
            jumped = written(parents.join(above, "parent", "left").select("node", F.coalesce("top", "parent").alias("parent"), F.col("parent").alias("was")), "parents")
            drop(was)
            parents, was = jumped.select("node", "parent"), jumped
            if jumped.where("parent != was").isEmpty():
                break
        moved_edges = written(_fewer(_through(edges, parents)), "links")
        drop(edges)
        edges = moved_edges
        if labels is None:  # every node is its own label before
            labels = parents.withColumnRenamed("parent", "label")
            labels._written_at = was._written_at
        else:
            moved = parents.select(F.col("node").alias("label"), F.col("parent").alias("top"))
            moved_labels = written(labels.join(moved, "label", "left").select("node", F.coalesce("top", "label").alias("label")), "labels")
            drop(labels, was)
            labels = moved_labels
    if labels is None:
        labels = written(edges.select(F.col("a").alias("node"), F.col("b").alias("label")), "labels")
    drop(edges)
    return labels
