"""Ranked lists: explicit ranks with a total order, fusion, paging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rank_list(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def top_k(df: DataFrame, keys: list[str], k: int, *order: Column) -> DataFrame:
    """The best k of each key, cut inside partitions before the shuffle (window group limit)."""
    return rank_list(df, keys, *order).where(F.col("rank") <= k)


def rrf_fuse(ranked: DataFrame, weights: dict[str, float], k: int = 60, limit: int | None = None) -> DataFrame:
    """(query_id, keyframe_id, scene_id, score, signals, contributions, rank) by weighted reciprocal rank.

    A missing weight is 1, a weight of 0 or less removes the retriever, a null keyframe is dropped, repeats add up.
    """
    weight = F.lit(1.0)
    for name, w in weights.items():
        weight = F.when(F.col("retriever") == name, float(w)).otherwise(weight)
    x = ranked.where("keyframe_id is not null").withColumn("w", weight).where("w > 0").withColumn("part", F.col("w") / (F.lit(k) + F.col("rank")))
    per = x.groupBy("query_id", "keyframe_id", "retriever").agg(F.sum("part").alias("part"), F.min("rank").alias("best"), F.min("scene_id").alias("scene_id"))
    ordered = F.sort_array(F.collect_list(F.struct("retriever", "part", "best")))
    fused = per.groupBy("query_id", "keyframe_id").agg(F.min("scene_id").alias("scene_id"), ordered.alias("s"))
    fused = fused.select("query_id", "keyframe_id", "scene_id", F.aggregate("s", F.lit(0.0), lambda a, e: a + e["part"]).alias("score"), F.map_from_entries(F.transform("s", lambda e: F.struct(e["retriever"], e["best"]))).alias("signals"), F.map_from_entries(F.transform("s", lambda e: F.struct(e["retriever"], e["part"]))).alias("contributions"))
    out = rank_list(fused, ["query_id"], F.round("score", 9).desc(), F.col("keyframe_id"))
    return out.where(F.col("rank") <= limit) if limit else out


def page(results: DataFrame, number: int, per_page: int = 24, keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """One page by rank, with total and has_more; page >= 1, per_page 1..100."""
    per_page, number = min(100, max(1, per_page)), max(1, number)
    total = results.groupBy(*keys).agg(F.count("*").alias("total"))
    last = number * per_page
    cut = results.where(F.col("rank").between(last - per_page + 1, last))
    return cut.join(total, list(keys)).withColumn("has_more", F.col("total") > last)


# Display labels of the retrievers.
LABELS = {"visual": "visual", "ocr": "text", "ocr_phrase": "text", "transcript": "speech", "asr_phrase": "speech", "caption": "caption"}


def merge_signal_labels(fused: DataFrame) -> DataFrame:
    """(query_id, keyframe_id, label, best, share, place): signals by display label; equal labels merge."""
    label = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv]), F.col("retriever")), F.col("retriever"))
    x = fused.select("query_id", "keyframe_id", "signals", F.explode("contributions").alias("retriever", "share"))
    x = x.withColumn("best", F.col("signals")[F.col("retriever")]).groupBy("query_id", "keyframe_id", label.alias("label")).agg(F.min("best").alias("best"), F.sum("share").alias("share"))
    return rank_list(x, ["query_id", "keyframe_id"], F.round("share", 9).desc(), F.col("best"), F.col("label")).withColumnRenamed("rank", "place")
