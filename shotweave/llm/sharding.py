"""Sharding by fixed virtual slots and a versioned slot-to-shard map.

Records are hashed into a fixed number of slots once and for all. What changes is the map from slots to shards: it starts
even, and rebalancing edits it by moving slots from full shards to empty ones, by the bytes that slots hold. The map has one
row per slot, so it is broadcast, and every version stays readable. Equal records are told apart by a copy number before they
are hashed, so no record is too hot for a slot; ranks are taken inside small bins of slots.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shotweave.sources.scratch import shared_dir, stored

SLOTS = 4096
#: Copies of one record beyond this number are made by several tasks; bins of slots hold about BIN_ROWS rows.
COPIES, BIN_ROWS = 10_000, 1_000_000


def first_map(shards: int, slots: int = SLOTS) -> np.ndarray:
    """Version 0: slots dealt in turn."""
    return np.arange(slots) % shards


def rebalanced(shard_of: np.ndarray, load: np.ndarray, shards: int, near: float = 0.001) -> np.ndarray:
    """The next version: slots move, or change places, from the fullest shard to the emptiest while that brings the two nearer.

    Ends when the two are apart by `near` of the mean at most, or no edit helps. Shards may be new: they are empty and fill
    up first, and slots that need not move stay. Slots without load never move. Shards beyond `shards` are emptied first.
    """
    out, load = shard_of.copy(), load.astype(np.int64)
    for slot in np.flatnonzero(out >= shards):
        out[slot] = np.argmin(_totals(out, load, shards))
    total, stuck = _totals(out, load, shards), np.zeros(shards, dtype=bool)
    while not stuck.all():
        high, low = int(np.argmax(np.where(stuck, -1, total))), int(np.argmin(total))
        gap = int(total[high] - total[low])
        if gap <= near * total.mean():
            break
        own, other = np.flatnonzero((out == high) & (load > 0)), np.flatnonzero(out == low)
        other = other[np.argsort(load[other], kind="stable")]
        # moving a slot is an exchange with nothing
        offers = np.append(0, load[other])
        at = np.searchsorted(offers, load[own] - gap / 2)
        best = None
        for place in (np.clip(at - 1, 0, len(offers) - 1), np.clip(at, 0, len(offers) - 1)):
            gain = load[own] - offers[place]
            fits = np.flatnonzero((gain > 0) & (gain < gap))
            if len(fits):
                i = fits[np.argmin(np.abs(2 * gain[fits] - gap))]
                found = (abs(2 * int(gain[i]) - gap), int(own[i]), int(place[i]))
                best = found if best is None else min(best, found)
        if best is None:
            stuck[high] = True
            continue
        out[best[1]] = low
        if best[2]:
            out[other[best[2] - 1]] = high
        total = _totals(out, load, shards)
    return out


def _totals(shard_of: np.ndarray, load: np.ndarray, shards: int) -> np.ndarray:
    total = np.zeros(shards, dtype=np.int64)
    inside = shard_of < shards
    np.add.at(total, shard_of[inside], load[inside])
    return total


def write_map(spark: SparkSession, path: str, version: int, shard_of: np.ndarray) -> None:
    """Adds a version to the map at `path`; versions that are there stay."""
    rows = [(i, int(x)) for i, x in enumerate(shard_of)]
    spark.createDataFrame(rows, "virtual_slot int, shard int").coalesce(1).write.parquet(f"{path}/version={version}")


def read_map(spark: SparkSession, path: str, version: int) -> DataFrame:
    """(virtual_slot, shard) of one version."""
    return spark.read.schema("virtual_slot int, shard int").parquet(f"{path}/version={version}")


def edits(spark: SparkSession, path: str, before: int, after: int) -> DataFrame:
    """(virtual_slot, from_shard, to_shard): the slots that move between two versions."""
    old = read_map(spark, path, before).withColumnRenamed("shard", "from_shard")
    return old.join(read_map(spark, path, after).withColumnRenamed("shard", "to_shard"), "virtual_slot").where("from_shard <> to_shard")


def slotted(docs: DataFrame, slots: int = SLOTS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, place, virtual_slot): every row's fixed slot. Rows that agree in id, size and checksum are
    numbered and hashed with their number."""
    own = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(own) + 1).cast("bigint").alias("size"), F.crc32(own).alias("text_crc32"))
    rows = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("n"))
    few = rows.where(F.col("n") <= COPIES).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)))
    many = rows.where(F.col("n") > COPIES).withColumn("first", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1, F.lit(COPIES).cast("bigint"))))
    many = many.repartition("doc_id", "size", "text_crc32", "first")
    many = many.withColumn("copy", F.explode(F.sequence("first", F.least(F.col("first") + COPIES, F.col("n")) - 1))).drop("first")
    place = F.xxhash64("doc_id", "size", "text_crc32", "copy")
    return few.unionByName(many).select("doc_id", "size", "text_crc32", place.alias("place")).withColumn("virtual_slot", F.pmod("place", F.lit(slots)).cast("int"))


def slot_loads(rows: DataFrame, slots: int = SLOTS) -> tuple[np.ndarray, int]:
    """Bytes per slot, and the number of rows: one row per slot reaches the driver."""
    out, n = np.zeros(slots, dtype=np.int64), 0
    for r in rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect():
        out[r["virtual_slot"]] = r["bytes"]
        n += r["n"]
    return out, n


def shard_rows(spark: SparkSession, docs: DataFrame, shards: int = 8, slots: int = SLOTS, path: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot) per row of `docs`, under the law `bytes`.

    The map at `path` (a new one in the shared folder by default) gets version 0 and, after rebalancing by the bytes of
    slots, version 1, which places the rows. `slot` numbers the rows of a shard from 0 without gaps, in the order of virtual
    slots. Size is the text's bytes plus 1; null texts count as empty. Null and repeated ids are rows like others. A text
    larger than a shard's share makes its shard larger. An empty table gives an empty result; other columns are not read.
    """
    path = path or f"{shared_dir(spark)}/slot-map-{spark.sparkContext.applicationId}-{spark._jvm.java.util.UUID.randomUUID()}"
    rows = stored(slotted(docs, slots, doc_id, text))
    load, n = slot_loads(rows, slots)
    shard_of = first_map(shards, slots)
    write_map(spark, path, 0, shard_of)
    write_map(spark, path, 1, rebalanced(shard_of, load, shards))
    owner = F.broadcast(read_map(spark, path, 1))  # one row per slot
    rows = rows.withColumn("bin", F.pmod(F.xxhash64("place"), F.lit(math.ceil(n / slots / BIN_ROWS) or 1)).cast("int"))
    before = Window.partitionBy("shard").orderBy("virtual_slot", "bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = rows.groupBy("virtual_slot", "bin").agg(F.count("*").alias("n")).join(owner, "virtual_slot")
    bins = bins.select("virtual_slot", "bin", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("virtual_slot", "bin").orderBy("place", "doc_id", "size", "text_crc32")
    ranked = rows.withColumn("rank", F.row_number().over(inside)).join(bins, ["virtual_slot", "bin"])
    return ranked.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + F.col("rank") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")
