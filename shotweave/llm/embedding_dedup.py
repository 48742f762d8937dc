"""Embedding near-duplicates: random-hyperplane sign hashing in several tables, exact cosine check, connected components.

Equal vectors of a label are one class. A class gets one sign code per table; classes that share (label, table, code) form a
bucket, and a bucket's pairs are verified by cosine in double precision inside tasks. Codes are long enough that a class
without near neighbours is mostly alone in its buckets; those end before any vector is moved. A pair that already met in an
earlier table is left to that table, so link counts are right without emitting pairs: a task returns counts per class and
one edge per class that connects what is linked in its bucket. Buckets over `block` classes are dealt out as block pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shotweave.llm.graph import components, stored


def tuned(classes: int, cosine: float, missed: float) -> tuple[int, int]:
    """(bits, tables): codes of about log2(2 * classes) bits, and enough tables that a pair at the threshold is missed with
    probability `missed` at most."""
    bits = min(40, max(6, math.ceil(math.log2(2 * max(classes, 2)))))
    agree = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, math.ceil(math.log(missed) / math.log(1 - agree))


def planes(dim: int, tables: int, bits: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, tables * bits))


def codes_of(x: np.ndarray, tables: int, bits: int, seed: int) -> np.ndarray:
    signs = (x @ planes(x.shape[1], tables, bits, seed) > 0).reshape(len(x), tables, bits)
    return signs @ (np.int64(1) << np.arange(bits, dtype=np.int64))


def _matrix(lists: pa.Array, dim: int) -> np.ndarray:
    """Unit rows in double precision of a list column whose lists are all of one length."""
    x = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that the norm can neither overflow nor vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _codes(tables: int, bits: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rep, label, dim = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            for d in np.unique(dim):
                mine = np.flatnonzero(dim == d)
                code = codes_of(_matrix(batch.column(3).take(pa.array(mine)), int(d)), tables, bits, seed)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(rep[mine], tables)), pa.array(np.repeat(label[mine], tables)), pa.array(np.repeat(dim[mine], tables)), pa.array(np.tile(np.arange(tables, dtype=np.int32), len(mine))), pa.array(code.ravel())], names=["rep", "label", "dim", "tab", "code"])

    return run


def linked(x: np.ndarray, code: np.ndarray, own: np.ndarray, one: int, two: int, table: int, cosine: float) -> np.ndarray:
    """Symmetric matrix of the links that this block pair has to report."""
    hit = x @ x.T >= cosine
    np.fill_diagonal(hit, False)
    for t in range(table):  # pairs that met in an earlier table
        if not hit.any():
            break
        hit &= code[:, t][:, None] != code[:, t][None, :]
    if one != two:
        hit &= own[:, None] != own[None, :]
    return hit


def _least_reached(hit: np.ndarray, rep: np.ndarray) -> np.ndarray:
    label = rep.copy()
    while True:
        least = np.minimum(label, np.where(hit, label[None, :], np.iinfo(np.int64).max).min(axis=1))
        if (least == label).all():
            return label
        label = least


FEW = 4  # buckets of up to so many classes are verified together, pair by pair


def _verify(cosine: float, tables: int, bits: int, seed: int):
    """Rows arrive sorted by their six keys (label, dim, tab, code, one, two), then own, v, rep and size."""

    def few(x: np.ndarray, tab: np.ndarray, rep: np.ndarray, size: np.ndarray, first: np.ndarray, count: np.ndarray) -> list[np.ndarray]:
        pairs = [(first[count > j] + i, first[count > j] + j) for j in range(1, FEW) for i in range(j)]
        a, b = (np.concatenate(z) for z in zip(*pairs, strict=True))
        hit = np.einsum("ij,ij->i", x[a], x[b]) >= cosine
        a, b = a[hit], b[hit]
        if len(a):  # pairs that met in an earlier table
            used, at = np.unique(np.concatenate([a, b]), return_inverse=True)
            code = codes_of(x[used], tables, bits, seed)
            met = (code[at[: len(a)]] == code[at[len(a) :]]) & (np.arange(tables)[None, :] < tab[a][:, None])
            a, b = a[~met.any(axis=1)], b[~met.any(axis=1)]
        return [np.concatenate([rep[a], rep[b]]), np.concatenate([size[b], size[a]]), np.concatenate([rep[b], rep[a]])]

    def many(x: np.ndarray, table: int, one: int, two: int, own: np.ndarray, rep: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
        code = codes_of(x, tables, bits, seed) if table else None
        hit = linked(x, code, own, one, two, table, cosine)
        at = np.flatnonzero(hit.any(axis=1))
        return [rep[at], hit[at] @ size, _least_reached(hit, rep)[at]]

    def close(t: pa.Table, bounds: np.ndarray, keys: np.ndarray) -> pa.RecordBatch:
        """The whole buckets of a table."""
        out = [[np.zeros(0, dtype=np.int64)] * 3]
        own, rep, size = (t[c].to_numpy() for c in ("own", "rep", "size"))
        first, count = bounds[:-1], np.diff(bounds)
        vectors = t["v"].combine_chunks()
        for dim in np.unique(keys[first, 1]) if len(first) else ():
            mine = keys[:, 1] == dim
            x = _matrix(vectors.filter(pa.array(mine)), int(dim))
            shift = np.cumsum(mine) - 1
            small = (keys[first, 1] == dim) & (count <= FEW)
            if small.any():
                out.append(few(x, keys[mine, 2], rep[mine], size[mine], shift[first[small]], count[small]))
            for lo, n in zip(first[(keys[first, 1] == dim) & (count > FEW)].tolist(), count[(keys[first, 1] == dim) & (count > FEW)].tolist(), strict=True):
                part = slice(lo, lo + n)
                out.append(many(x[shift[lo] : shift[lo] + n], int(keys[lo, 2]), int(keys[lo, 4]), int(keys[lo, 5]), own[part], rep[part], size[part]))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*out, strict=True)], names=["rep", "links", "reach"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None  # the bucket that may go on in the next batch

        def settle(rest: bool) -> tuple[pa.RecordBatch, list[pa.RecordBatch]]:
            t = pa.Table.from_batches(held)
            keys = np.stack([t.column(i).to_numpy().astype(np.int64) for i in range(6)], axis=1)
            start = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(axis=1)))
            end = len(keys) if rest else int(start[-1])
            tail = [] if rest else t.slice(end).combine_chunks().to_batches()
            return close(t.slice(0, end), np.unique(np.append(start[start <= end], end)), keys[:end]), tail

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            key = tuple(batch.column(i)[-1].as_py() for i in range(6))
            if key != last:  # else the whole batch belongs to the bucket that is held
                out, held = settle(False)
                yield out
            last = key
        if held:
            yield settle(True)[0]

    return run


def near_vectors(spark: SparkSession, df: DataFrame, cosine: float = 0.98, missed: float = 1e-5, block: int = 400, seed: int = 17, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row of `df`.

    Two rows link when their labels are equal and not null and their cosine is at least `cosine`; the chance to miss a link
    at the threshold itself is `missed`, and less above it. Null, zero, or empty vectors, vectors with null or non-finite
    components, and rows with a null label or id link with nothing. Vectors of different widths never link. Repeated ids
    are rows of their own. component_id is the least id that links reach, and kept says that it is the row's own. Ids and
    labels must be whole numbers or their texts. An empty table gives an empty result; other columns are not read.
    """
    base = df.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(vector).alias("v"), F.col(label).cast("bigint").alias("label"))
    good = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = base.withColumn("good", good)
    classes = stored(rows.where("good").groupBy("label", "v").agg(F.min("vec_id").alias("least"), F.count("*").alias("size")).withColumns({"dim": F.size("v"), "rep": F.monotonically_increasing_id()}))  # stored, so a class keeps its number
    top = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    bits, tables = tuned(top, cosine, missed)
    # codes without vectors; buckets of one class end here
    code = stored(classes.select("rep", "label", "dim", "v").mapInArrow(_codes(tables, bits, seed), "rep bigint, label bigint, dim int, tab int, code bigint"))
    bucket = code.groupBy("label", "dim", "tab", "code").count().where("count > 1").withColumn("blocks", F.ceil(F.col("count") / F.lit(block)).cast("int"))
    seats = code.join(bucket, ["label", "dim", "tab", "code"]).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    seats = seats.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    seat = F.struct("tab", "code", F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"), "own")
    by_rep = seats.groupBy("rep").agg(F.collect_list(seat).alias("seats"))  # tables * blocks entries at most
    dealt = classes.join(by_rep, "rep").select("label", "dim", F.explode("seats").alias("s"), "v", "rep", "size")
    keys = ["label", "dim", "tab", "code", "one", "two"]
    dealt = dealt.select("label", "dim", "s.tab", "s.code", "s.one", "s.two", "s.own", "v", "rep", "size")
    found = stored(dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_verify(cosine, tables, bits, seed), "rep bigint, links bigint, reach bigint"))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    # classes have numbers of their own, as ids may repeat; a component's id is the least one of its classes
    groups = components(spark, found.select(F.col("rep").alias("a"), F.col("reach").alias("b")))
    named = groups.join(classes.select(F.col("rep").alias("node"), "least"), "node").groupBy("component").agg(F.min("least").alias("first"))
    groups = groups.join(named, "component").select("node", "first")
    per_class = classes.join(links, "rep", "left").join(groups, classes["rep"] == groups["node"], "left")
    per_class = per_class.select(F.col("label").alias("l"), F.col("v").alias("w"), (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n"), F.coalesce("first", "least").alias("c"))
    joined = rows.join(per_class, F.col("good") & (F.col("label") == F.col("l")) & (F.col("v") == F.col("w")), "left")
    out = joined.select("vec_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("c", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))
