"""What requests show: stage labels, details, chain enrichment, flags and the result sink."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotweave.operators.search import enrich

def registered_models_with_rows(models: DataFrame, vectors: DataFrame) -> DataFrame:
    """Models that have vectors; the vectors are reduced to distinct ids before they meet the registry."""
    return models.join(vectors.select("model_id").distinct(), "model_id", "left_semi")


def stage_label(stages: DataFrame) -> DataFrame:
    """(query_id, stage, label): what a stage searches for, rebuilt from its parts."""
    quoted = lambda name, c: F.when(F.col(c) != "", F.concat(F.lit(f'{name}:"'), F.col(c), F.lit('"')))
    text = F.when(F.col("free_text") != "", F.col("free_text"))
    return stages.select("query_id", "stage", F.concat_ws(" ", quoted("text", "ocr_phrase"), quoted("said", "asr_phrase"), text).alias("label"))


def temporal_summary(stages: DataFrame, hits: DataFrame, chains: DataFrame) -> DataFrame:
    """(query_id, stage, label, gap_ms, hits, chains) of every stage of a query."""
    n = hits.groupBy("query_id", "stage").agg(F.count("*").alias("hits"))
    c = chains.groupBy("query_id").agg(F.count("*").alias("chains"))
    x = stage_label(stages).join(stages.select("query_id", "stage", "gap_ms"), ["query_id", "stage"]).join(n, ["query_id", "stage"], "left").join(c, "query_id", "left")
    return x.fillna(0, ["hits", "chains"])


def signals_used(ranked: DataFrame) -> DataFrame:
    """(query_id, signal): retrievers with a hit; with a `stage` column, the stage comes first."""
    name = F.concat(F.lit("s"), F.col("stage").cast("string"), F.lit(":"), F.col("retriever")) if "stage" in ranked.columns else F.col("retriever")
    return ranked.select("query_id", name.alias("signal")).distinct()


def video_details(videos: DataFrame, wanted: DataFrame) -> DataFrame:
    """Wanted videos (video_id) with their length in seconds; unknown ids give no row."""
    return videos.join(wanted.select("video_id"), "video_id", "left_semi").withColumn("seconds", F.bround(F.col("duration_ms") / 1000, 0).cast("int")).drop("duration_ms")


def scene_details(scenes: DataFrame, keyframes: DataFrame, wanted: DataFrame) -> DataFrame:
    """Wanted scenes (scene_id) with their default keyframe, the middle of the filmstrip; unknown ids give no row."""
    cut = scenes.join(wanted.select("scene_id"), "scene_id", "left_semi")
    strip = keyframes.join(cut.select("scene_id"), "scene_id", "left_semi").groupBy("scene_id").agg(F.sort_array(F.collect_list(F.struct("ts_ms", "keyframe_id"))).alias("k"))
    return cut.join(strip, "scene_id", "left").withColumn("keyframe_id", F.get("k", F.floor(F.size("k") / 2).cast("int"))["keyframe_id"]).drop("k")


def session_list(writes: DataFrame, now, idle_ms: int = 2 * 60 * 60 * 1000) -> DataFrame:
    """(code, instances, expires_in_ms): recorded scenes of each session, and the time until it expires at `now`."""
    since = (now - F.max(F.unix_millis(F.col("ts").cast("timestamp_ltz")))).cast("bigint")
    return writes.where("scene_id is not null").groupBy("code").agg(F.count_distinct("scene_id").alias("instances"), F.greatest(F.lit(0), F.lit(idle_ms) - since).cast("bigint").alias("expires_in_ms"))


def enrich_chains(chains: DataFrame, t: dict[str, DataFrame]) -> DataFrame:
    """Chains with the detail of all their places, (query_id, rank, score, gaps_ms, scenes); a partial chain drops out."""
    step = chains.select("query_id", "rank", "reached", "gaps_ms", F.size("path").alias("__n"), F.posexplode("path").alias("place", "p"))
    detail = enrich(step.select("query_id", "rank", "gaps_ms", "__n", "place", F.col("reached").alias("score"), F.col("p.keyframe_id").alias("keyframe_id"), F.col("p.scene_id").alias("scene_id")), t)
    one = F.struct("place", "keyframe_id", "scene_id", "video_id", "shot_index", "start_ms", "ts_ms", "keyframes")
    out = detail.groupBy("query_id", "rank").agg(F.first("score").alias("score"), F.first("gaps_ms").alias("gaps_ms"), F.first("__n").alias("__n"), F.sort_array(F.collect_list(one)).alias("scenes"))
    return out.where(F.size("scenes") == F.col("__n")).drop("__n")


def already_submitted(results: DataFrame, log: DataFrame) -> DataFrame:
    """Results with a flag `submitted` where the log holds their (video_id, keyframe_id)."""
    keys = ["video_id", "keyframe_id"]
    return results.join(log.select(keys).distinct().withColumn("submitted", F.lit(True)), keys, "left").fillna(False, ["submitted"])


def stability_check(first: DataFrame, second: DataFrame) -> DataFrame:
    """(run, ...): rows that only one of two runs gives; empty when both are the same."""
    a, b = first.exceptAll(second), second.select(first.columns).exceptAll(first)
    return a.select(F.lit(1).alias("run"), "*").unionByName(b.select(F.lit(2).alias("run"), "*"))


def write_results(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Writes results, nested filmstrips and chains included, as Parquet or JSON; a path that exists is an error."""
    if kind not in ("parquet", "json"):
        raise ValueError(f"kind must be parquet or json: {kind}")
    df.write.format(kind).save(path)
