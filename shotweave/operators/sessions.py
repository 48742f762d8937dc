"""Shared search sessions: last-write merge, expiry, snapshots, hiding held scenes. Batch twins of the streaming jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shotweave.operators.ordered import with_previous, with_running_sum

FINAL = ("CORRECT", "WRONG", "UNDECIDABLE")
HOLDS = ("CORRECT", "INDETERMINATE")


def session_records(writes: DataFrame) -> DataFrame:
    """State per (code, scene_id) after all writes in (ts, event_id) order.

    A missing status is INDETERMINATE, a final status is never replaced by another kind (the whole write is ignored), null
    fields keep the old value, and writes without a scene are rejected.
    """
    x = writes.where("scene_id is not null").withColumn("status", F.coalesce("status", F.lit("INDETERMINATE")))
    order = F.struct("ts", "event_id")
    first_final = F.min(F.when(F.col("status").isin(*FINAL), order)).over(Window.partitionBy("code", "scene_id"))
    x = x.withColumn("cut", first_final).where(F.col("cut").isNull() | F.col("status").isin(*FINAL) | (order < F.col("cut")))
    return x.groupBy("code", "scene_id").agg(F.max_by("status", order).alias("status"), F.max_by("video_id", F.when(F.col("video_id").isNotNull(), order)).alias("video_id"), F.max("event_id").alias("last_event"))


def sessions_by_idle(writes: DataFrame, minutes: int = 120) -> DataFrame:
    """(code, instance, first_event, last_event, writes): a new instance begins after more than `minutes` without a write.

    Writes are scanned in hours of their time; what a session hands from hour to hour is a row each.
    """
    seconds = F.col("ts").cast("long")
    hour, order = F.floor(seconds / 3600), ["ts", "event_id"]
    x = with_previous(writes, ["code"], hour, order, seconds, "before")
    begins = F.when(seconds - F.col("before") > minutes * 60, 1).otherwise(0)
    x = with_running_sum(x, ["code"], hour, order, begins, "instance")
    return x.groupBy("code", "instance").agg(F.min("event_id").alias("first_event"), F.max("event_id").alias("last_event"), F.count("*").alias("writes"))


def live_sessions(activity: DataFrame, now, minutes: int = 120) -> DataFrame:
    """(code, last_activity, expires_in_ms) of sessions that live at `now`.

    activity: code, ts, kind. Recording, reading and joining keep a session alive; listing and peeking do not. A session ends
    after more than `minutes` without them.
    """
    seen = activity.where(~F.lower("kind").isin("list", "peek")).groupBy("code").agg(F.max("ts").alias("last_activity"))
    left = F.lit(minutes * 60_000) - (F.unix_millis(now) - F.unix_millis(F.col("last_activity").cast("timestamp_ltz")))
    return seen.withColumn("expires_in_ms", left.cast("bigint")).where("expires_in_ms >= 0")


def held_scenes(records: DataFrame) -> DataFrame:
    return records.where(F.col("status").isin(*HOLDS)).select("code", "scene_id", "video_id")


def session_snapshot(records: DataFrame) -> DataFrame:
    """Per session: instances, distinct videos, and how many videos are covered by a held scene."""
    return records.groupBy("code").agg(F.count("*").alias("instances"), F.count_distinct("video_id").alias("distinct_videos"), F.count_distinct(F.when(F.col("status").isin(*HOLDS), F.col("video_id"))).alias("covered_videos"))


def hide_held(results: DataFrame, held: DataFrame, code: int | None = None) -> DataFrame:
    """Results without any keyframe of a scene that the session holds; an unknown session hides nothing.

    With a column `code` in the results, every result is that of a session of its own; without one, all are those of `code`.
    """
    if code is None:
        return results.join(held.select("code", "scene_id").distinct(), ["code", "scene_id"], "left_anti")
    return results.join(held.where(F.col("code") == code).select("scene_id"), "scene_id", "left_anti")
