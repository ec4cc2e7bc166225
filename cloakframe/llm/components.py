"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import delete, materialise


#: Edges, of 16 bytes each, that one task connects at once; more are connected in rounds, with the same components.
FEW_EDGES = 1 << 20


def connected_components(edges: DataFrame, max_rounds: int = 60, few: int = FEW_EDGES) -> DataFrame:
    """(node, component) for every node of edges (a, b) that isn't itself the smallest of its component.

    Up to few distinct edges, which are counted first, make one task. Else each round joins the edges with the smallest neighbour of each node. Both sides of
    those joins are written tables, so that Spark can split a node of very many edges
    over several tasks; the smallest neighbours are combined before they are shuffled.
    Nothing is gathered on the driver but one row of totals.
    """
    now = materialise(_ordered(edges.select(F.col("a").alias("u"), F.col("b").alias("v"))).distinct())
    if now.count() <= few:
        return now.coalesce(1).mapInArrow(_at_once, "node long, component long")
    seen = None
    for _ in range(max_rounds):
        both = now.select("u", "v").unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialise(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = materialise(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        delete(least)
        least = materialise(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        after = materialise(small.where("u <> v").distinct())
        for old in (least, large, now):
            delete(old)
        now = after
        total = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if total == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        seen = total
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def _at_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ends = [np.stack([c.to_numpy() for c in batch.columns], 1) for batch in batches]
    whole = np.concatenate([np.empty((0, 2), np.int64), *ends])
    node, component = forest(whole[:, 0], whole[:, 1])
    for at in range(0, len(node), 100_000):
        yield pa.record_batch([pa.array(node[at : at + 100_000]), pa.array(component[at : at + 100_000])], ["node", "component"])


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smallest node of its component) that connect what the edges (a, b) connect."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        after = label.copy()
        np.minimum.at(after, label[x], low)
        np.minimum.at(after, label[y], low)
        while True:
            jumped = after[after]
            if (jumped == after).all():
                break
            after = jumped
        if (after == label).all():
            break
        label = after
    own = label != np.arange(len(nodes))
    return nodes[own], nodes[label[own]]
