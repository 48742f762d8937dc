"""Distributed connected components over an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shotweave.sources.scratch import cut, stored

__all__ = ["components", "stored"]

#: Edges that a task holds at once: 16 MB, and some times that while they are contracted.
HELD = 1 << 20


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node that it reaches over the given edges), without the least nodes themselves."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        lo, hi = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
        open_ = lo != hi
        if not open_.any():
            moved = np.flatnonzero(root != np.arange(len(nodes)))
            return nodes[moved], nodes[root[moved]]
        x, y = x[open_], y[open_]
        np.minimum.at(root, hi[open_], lo[open_])
        while (root[root] != root).any():
            root = root[root]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces a task's edges (a, b) by stars that connect the same nodes, of at most `HELD` edges at a time."""
    batch_of = lambda e: pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in e], names=["a", "b"])
    held, n = [], 0
    for batch in batches:
        held.append(tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns))
        n += batch.num_rows
        if n >= HELD:
            own = stars(*map(np.concatenate, zip(*held, strict=True)))
            held, n = [own], len(own[0])
            if n > HELD // 2:  # little is gained here: they go as they are
                yield batch_of(own)
                held, n = [], 0
    if n:
        yield batch_of(stars(*map(np.concatenate, zip(*held, strict=True))))


def components(spark: SparkSession, edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): the least node that each node of `edges` (a, b: bigint) reaches.

    Alternates the large-star and small-star steps (Kiveris et al., 2014): every step is one minimum per node, computed
    with map-side combine, and one join. The join has a second key that follows from the node, so its sides are shuffled for
    the join itself and adaptive execution can split the rows of a hot node, such as the centre of a star, over tasks. Before
    the first shuffle each task replaces the edges that it reads by stars that connect the same nodes, so edges that others
    of the same task imply are never moved. The edge table is checkpointed after each round. Null ends and loops are ignored.
    Nodes without a link do not appear.
    """
    twin = F.pmod(F.col("a"), F.lit(2))
    linked = edges.where("a is not null and b is not null and a <> b").select(F.col("a").cast("bigint"), F.col("b").cast("bigint"))
    e = cut(linked.mapInArrow(_contract, "a bigint, b bigint").distinct())
    before = None
    for _ in range(max_rounds):
        mark = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before or mark[0] == 0:
            break
        before = mark
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.withColumn("twin", twin).join(least.withColumn("twin", twin), ["a", "twin"]).where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = large.distinct()
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.withColumn("twin", twin).join(least.withColumn("twin", twin), ["a", "twin"]).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        e = cut(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    else:
        raise RuntimeError("connected components did not settle")
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
