"""Browsing, work lists, lifecycle reports and evaluation."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotweave.operators.ordered import with_previous
from shotweave.operators.ranking import rank_list, top_k
from shotweave.sources.corpus import STAGES


def pending(entities: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Work without an output row."""
    return entities.join(done.select(keys), keys, "left_anti")


def in_scope(keyframes: DataFrame, scope: str) -> DataFrame:
    """Every keyframe (`all`), or the first of each shot (`shot`)."""
    if scope not in ("all", "shot"):
        raise ValueError(f"scope must be all or shot: {scope}")
    return keyframes.where("kf_index = 0") if scope == "shot" else keyframes


def shard(df: DataFrame, key: str, i: int, n: int) -> DataFrame:
    """The i-th of n parts: numbers by remainder, text ids by a hash."""
    number = F.col(key) if dict(df.dtypes)[key] in ("int", "bigint", "smallint") else F.xxhash64(key)
    return df.where(F.pmod(number, F.lit(n)) == i)


# Stage, entities, key, the table that tells what is done, and whether the scope applies.
WORK = {
    "vectors": ("keyframes", "keyframe_id", "keyframe_embedding", False),
    "text": ("keyframes", "keyframe_id", "keyframe_text", True),
    "captions": ("keyframes", "keyframe_id", "keyframe_caption", True),
    "transcripts": ("videos", "video_id", "transcript_segment", False),
    "caption_vectors": ("keyframe_caption", "keyframe_id", "caption_embedding", False),
    "transcript_vectors": ("transcript_segment", "segment_id", "transcript_embedding", False),
}


def pending_work(t: dict[str, DataFrame], stage: str, collection: str | None = None, part: tuple[int, int] | None = None, scope: str = "all", model_id: int | None = None) -> DataFrame:
    """What a stage still has to do, in one collection (null or blank: all) and one of n parts.

    Videos need sound to be transcribed and texts need content to be embedded; vectors are pending per model.
    """
    entities, key, done, scoped = WORK[stage]
    x = t[entities]
    if stage == "transcripts":
        x = x.where("has_audio")
    if entities == "keyframe_caption":
        x = x.where("trim(caption) <> ''")
    if entities == "transcript_segment":
        x = x.where("trim(text) <> ''")
    if collection and collection.strip():
        if "video_id" not in x.columns:
            x = x.join(t["keyframes"].select("keyframe_id", "video_id"), "keyframe_id")
        x = x.join(t["videos"].where(F.col("collection") == collection.strip().upper()).select("video_id"), "video_id", "left_semi")
    x = in_scope(x, scope) if scoped else x
    x = shard(x, key, *part) if part else x
    finished = t[done].where(F.col("model_id") == model_id) if model_id is not None else t[done]
    return pending(x, finished, [key]).select(key)


def pending_counts(t: dict[str, DataFrame], stages: list[str] | None = None, **kwargs) -> DataFrame:
    """(stage, n): how much each stage still has to do."""
    parts = [pending_work(t, s, **kwargs).agg(F.count("*").alias("n")).select(F.lit(s).alias("stage"), "n") for s in stages or WORK]
    return reduce(DataFrame.unionByName, parts)


def scene_counts(videos: DataFrame, scenes: DataFrame) -> DataFrame:
    n = scenes.groupBy("video_id").agg(F.count("*").alias("scenes"))
    return videos.select("video_id").join(n, "video_id", "left").select("video_id", F.coalesce("scenes", F.lit(0)).alias("scenes"))


def video_cover(videos: DataFrame, scenes: DataFrame, keyframes: DataFrame) -> DataFrame:
    """(video_id, keyframe_id): of the first shot with keyframes the one nearest its middle; null when there is none."""
    x = scenes.join(keyframes.drop("video_id"), "scene_id").withColumn("off", F.abs(F.col("ts_ms") - F.floor((F.col("start_ms") + F.col("end_ms")) / 2)))
    best = x.groupBy("video_id").agg(F.min_by("keyframe_id", F.struct("shot_index", "off", "keyframe_id")).alias("keyframe_id"))
    return videos.select("video_id").join(best, "video_id", "left")


def browse_videos(videos: DataFrame, scenes: DataFrame, keyframes: DataFrame, number: int, per_page: int = 25) -> DataFrame:
    """One page of videos, cut before cover and count are joined."""
    cut = videos.orderBy("video_id").offset((number - 1) * per_page).limit(per_page)
    return cut.join(video_cover(cut, scenes, keyframes), "video_id").join(scene_counts(cut, scenes), "video_id").select("video_id", "collection", F.bround(F.col("duration_ms") / 1000, 0).cast("int").alias("seconds"), "keyframe_id", "scenes")


def browse_scenes(scenes: DataFrame, keyframes: DataFrame, video_id: str, number: int, per_page: int = 60) -> DataFrame:
    """One page of a video's scenes; the thumbnail is the middle keyframe."""
    cut = scenes.where(F.col("video_id") == video_id).orderBy("shot_index").offset((number - 1) * per_page).limit(per_page)
    strip = keyframes.join(F.broadcast(cut.select("scene_id")), "scene_id").groupBy("scene_id").agg(F.sort_array(F.collect_list(F.struct("ts_ms", "keyframe_id"))).alias("k"))
    x = cut.join(strip, "scene_id", "left")
    return x.select("scene_id", "shot_index", "start_ms", "end_ms", F.coalesce(F.size("k"), F.lit(0)).alias("keyframes"), F.get("k", F.floor(F.size("k") / 2).cast("int"))["keyframe_id"].alias("thumbnail"))


def videos_complete(videos: DataFrame, scenes: DataFrame, keyframes: DataFrame) -> DataFrame:
    """Videos that have scenes, and no scene without a keyframe."""
    missing = scenes.join(keyframes.select("scene_id"), "scene_id", "left_anti")
    return videos.select("video_id").join(scenes.select("video_id"), "video_id", "left_semi").join(missing.select("video_id"), "video_id", "left_anti")


def audio_complete(videos: DataFrame, segments: DataFrame) -> DataFrame:
    heard = segments.select("video_id").distinct().withColumn("heard", F.lit(True))
    return videos.join(heard, "video_id", "left").where("not has_audio or heard").select("video_id")


def purge_eligible(videos: DataFrame, scenes: DataFrame, keyframes: DataFrame, segments: DataFrame) -> DataFrame:
    """(video_id, candidates, audio): which transient artefacts of a video are no longer needed."""
    c = videos_complete(videos, scenes, keyframes).withColumn("candidates", F.lit(True))
    a = audio_complete(videos, segments).withColumn("audio", F.lit(True))
    return videos.select("video_id").join(c, "video_id", "left").join(a, "video_id", "left").select("video_id", F.coalesce("candidates", F.lit(False)).alias("candidates"), F.coalesce("audio", F.lit(False)).alias("audio"))


def purge_files(t: dict[str, DataFrame], files: DataFrame, web: str = "web", raw: str = "work/raw", candidates: str = "work/candidates", audio: str = "work/audio") -> DataFrame:
    """(kind, video_id, path, bytes): transient files that no later stage needs.

    files: path, bytes. A raw file goes once its video has a web copy and candidate frames, candidates once all shots have
    keyframes, sound once there is a transcript or nothing to transcribe.
    """
    folder, name = F.regexp_extract("path", r"^(.*)/[^/]*$", 1), F.regexp_extract("path", r"([^/.]*)[^/]*$", 1)
    f = files.withColumn("folder", folder).withColumn("video_id", F.when(F.startswith(folder, F.lit(candidates + "/")), F.regexp_extract(folder, r"([^/]*)$", 1)).otherwise(name))
    kind = F.when(F.col("folder") == raw, "raw").when(F.startswith("folder", F.lit(candidates)), "candidates").when(F.col("folder") == audio, "audio").when(F.col("folder") == web, "web")
    f = f.withColumn("kind", kind)
    has = lambda k: f.where(F.col("kind") == k).select("video_id")
    done = purge_eligible(t["videos"], t["scenes"], t["keyframes"], t["transcript_segment"])
    gone = {"raw": has("web").intersect(has("candidates")), "candidates": done.where("candidates").select("video_id"), "audio": done.where("audio").select("video_id")}
    parts = [f.where(F.col("kind") == k).join(ids, "video_id", "left_semi").select("kind", "video_id", "path", "bytes") for k, ids in gone.items()]
    return reduce(DataFrame.unionByName, parts)


def selection_report(scenes: DataFrame, keyframes: DataFrame, blank: DataFrame | None = None) -> DataFrame:
    """Totals of keyframe selection; `blank` (scene_id) lists shots whose candidates were all blank."""
    n = keyframes.groupBy("scene_id").agg(F.count("*").alias("n"))
    x = scenes.join(n, "scene_id", "left").select("scene_id", "video_id", F.coalesce("n", F.lit(0)).alias("n"))
    if blank is not None:
        x = x.join(blank.select("scene_id").distinct().withColumn("blank", F.lit(True)), "scene_id", "left")
    return x.agg(
        F.count_distinct("video_id").alias("videos"), F.count("*").alias("scenes"), F.sum("n").alias("keyframes"), F.count_if(F.col("n") < 2).alias("short_scenes"), F.count_if(F.col("n") == 0).alias("empty_scenes"),
        (F.count_if("blank") if blank is not None else F.lit(0).cast("bigint")).alias("blank_scenes"), F.round(F.avg("n"), 6).alias("per_scene"),
    )


def content_counts(t: dict[str, DataFrame], names: list[str]) -> DataFrame:
    parts = [t[n].agg(F.count("*").alias("rows")).select(F.lit(n).alias("table"), "rows") for n in names]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def job_state(events: DataFrame) -> DataFrame:
    """Latest stage per video, with the number of failures; unknown stages are no events."""
    return events.where(F.col("stage").isin(STAGES)).groupBy("video_id").agg(F.max_by("stage", F.struct("ts", "event_id")).alias("stage"), F.count_if(F.col("stage") == "FAILED").alias("failures"), F.max("event_id").alias("last_event"))


def restrict_to_queue(df: DataFrame, jobs: DataFrame) -> DataFrame:
    """Only queued videos; an empty queue restricts nothing."""
    queue = jobs.where("stage <> 'FAILED'").select("video_id").distinct().withColumn("queued", F.lit(True))
    empty = queue.agg((F.count("*") == 0).alias("empty"))  # one row
    return df.join(queue, "video_id", "left").crossJoin(F.broadcast(empty)).where("queued or empty").select(df.columns)


def recall_at_k(approx: DataFrame, exact: DataFrame, k: int) -> DataFrame:
    """(query_id, recall): share of the exact top k that the approximate one holds."""
    a, e = (x.where(F.col("rank") <= k).select("query_id", "keyframe_id") for x in (approx, exact))
    hit = a.intersect(e).groupBy("query_id").agg(F.count("*").alias("hit"))
    return e.groupBy("query_id").agg(F.count("*").alias("n")).join(hit, "query_id", "left").select("query_id", F.round(F.coalesce("hit", F.lit(0)) / F.col("n"), 6).alias("recall"))


def first_frame_share(results: DataFrame, keyframes: DataFrame, k: int = 15) -> DataFrame:
    return results.where(F.col("rank") <= k).join(keyframes.select("keyframe_id", "kf_index"), "keyframe_id").groupBy("query_id").agg(F.round(F.avg((F.col("kf_index") == 0).cast("int")), 6).alias("share"))


def score_range(ranked: DataFrame, n: int = 20) -> DataFrame:
    return ranked.where(F.col("rank") <= n).groupBy("retriever").agg(F.min("score").alias("low"), F.max("score").alias("high"))


def farthest_point_select(vectors: DataFrame, keyframes: DataFrame, k: int = 2) -> DataFrame:
    """Per scene: the vector nearest the centroid, then again and again the one farthest from all chosen; in time order.

    A scene's vectors are few and meet in one task; scenes are spread over all tasks.
    """

    def select(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ts_ms", "keyframe_id"], ignore_index=True)
        x = np.stack(pdf["embedding"]).astype(float)
        chosen = [int(((x - x.mean(axis=0)) ** 2).sum(axis=1).argmin())] if len(pdf) > k else list(range(len(pdf)))
        gap = ((x - x[chosen[0]]) ** 2).sum(axis=1)
        while len(chosen) < min(k, len(pdf)):
            nxt = int(gap.argmax())
            if nxt in chosen:
                break
            chosen.append(nxt)
            gap = np.minimum(gap, ((x - x[nxt]) ** 2).sum(axis=1))
        out = pdf.loc[sorted(chosen), ["scene_id", "keyframe_id"]]
        return out.assign(place=np.arange(len(out), dtype=np.int32))

    x = keyframes.join(vectors, "keyframe_id").select("scene_id", "keyframe_id", "ts_ms", "embedding")
    return x.groupBy("scene_id").applyInPandas(select, "scene_id bigint, keyframe_id bigint, place int")


def keyframe_index(selected: DataFrame) -> DataFrame:
    return rank_list(selected, ["scene_id"], F.col("ts_ms"), F.col("keyframe_id")).withColumn("index", F.col("rank") - 1).drop("rank")


#: Shots of a video that one task compares.
SHOT_RANGE = 100_000


def overlap_warnings(scenes: DataFrame) -> DataFrame:
    """Shots that start before the previous one ends; shots are compared in ranges of their index."""
    place = F.floor(F.col("shot_index") / SHOT_RANGE)
    return with_previous(scenes, ["video_id"], place, ["shot_index"], F.col("end_ms"), "before").where("start_ms < before")


def query_history(log: DataFrame, n: int = 10) -> DataFrame:
    """Each user's last n distinct queries, newest first."""
    return top_k(log.groupBy("user_id", "query").agg(F.max("ts").alias("ts")), ["user_id"], n, F.col("ts").desc(), F.col("query"))


def submission_check(answers: DataFrame) -> DataFrame:
    """(valid, reason): needs a media item or text; an item needs a collection; text may not be blank; the first of a set counts."""
    empty = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    reason = F.when(empty("media_item") & F.col("text").isNull(), "no answer").when(~empty("media_item") & empty("collection"), "no collection").when(empty("media_item") & empty("text"), "empty text")
    return top_k(answers, ["answer_set"], 1, F.col("answer")).drop("rank").withColumn("reason", reason).withColumn("valid", F.col("reason").isNull())
