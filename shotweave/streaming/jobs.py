"""Structured Streaming jobs: session state, job state, event windows, incremental enrichment."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from shotweave.operators.sessions import FINAL, HOLDS, session_records, session_snapshot
from shotweave.sources.corpus import STAGES, latest
from shotweave.sources.keyed import KeyedTable
from shotweave.sources.scratch import stored

IDLE_MS = 2 * 60 * 60 * 1000
RECORD = "status string, video_id string, ts timestamp, event_id bigint"


class SessionFold(StatefulProcessor):
    """Keeps the merged record of every scene of a session, by the writes' own times, and its last activity.

    A write is merged by (ts, event_id), not by arrival: a record's status is that of the last final write, or of the last
    write while none is final; a field keeps its last value that is not null. An event-time timer ends an idle session;
    `kind` tells what a row is: only list and peek do not keep the session alive, and only writes have a scene.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.final = handle.getMapState("final", "scene_id bigint", RECORD)
        self.open = handle.getMapState("open", "scene_id bigint", RECORD)
        self.video = handle.getMapState("video", "scene_id bigint", RECORD)
        self.active = handle.getValueState("active", "ts timestamp")

    def _later(self, state, scene: int, row: tuple) -> None:
        old = state.getValue((scene,)) if state.containsKey((scene,)) else None
        if old is None or (pd.Timestamp(old[2]), old[3]) < (pd.Timestamp(row[2]), row[3]):
            state.updateValue((scene,), row)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last = self.active.get()[0] if self.active.exists() else None
        for batch in rows:
            for r in batch.itertuples():
                if str(r.kind).lower() not in ("list", "peek") and (last is None or pd.Timestamp(r.ts) > pd.Timestamp(last)):
                    last = r.ts
                if pd.isna(r.scene_id) or str(r.kind).lower() != "write":
                    continue
                scene, status = int(r.scene_id), r.status or "INDETERMINATE"
                row = (status, r.video_id, r.ts.to_pydatetime(), int(r.event_id))
                self._later(self.final if status in FINAL else self.open, scene, row)
                if r.video_id:
                    self._later(self.video, scene, row)
        if last is not None:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.active.update((pd.Timestamp(last).to_pydatetime(),))
            self.handle.registerTimer(int(pd.Timestamp(last).timestamp() * 1000) + IDLE_MS + 1)
        yield self._records(key)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        for state in (self.final, self.open, self.video, self.active):
            state.clear()
        yield self._ended(key)

    def _ended(self, key) -> pd.DataFrame:
        """A row without a scene."""
        return pd.DataFrame([(key[0], None, None, None)], columns=["code", "scene_id", "status", "video_id"]).astype({"scene_id": "Int64"})

    def _records(self, key) -> pd.DataFrame:
        held = {k[0]: v for k, v in self.open.iterator()} | {k[0]: v for k, v in self.final.iterator()}
        video = {k[0]: v[1] for k, v in self.video.iterator()}
        found = [(key[0], scene, v[0], video.get(scene)) for scene, v in held.items()]
        return pd.DataFrame(found, columns=["code", "scene_id", "status", "video_id"])

    def close(self) -> None:
        pass


def session_stream(writes: DataFrame, late: str = "2 hours") -> DataFrame:
    """Merged records of the sessions that a micro-batch touches. writes: event_id, ts, code, scene_id, video_id, status and
    optionally kind (write, get, join, list, peek); the watermark is as late as the idle timeout."""
    own = writes if "kind" in writes.columns else writes.withColumn("kind", F.lit("write"))
    return own.withWatermark("ts", late).groupBy("code").transformWithStateInPandas(statefulProcessor=SessionFold(), outputStructType="code int, scene_id bigint, status string, video_id string", outputMode="Update", timeMode="EventTime")


class SnapshotFold(SessionFold):
    """The same state, but a row per session that a batch changed: its counts, or zeros once it has ended."""

    def _records(self, key) -> pd.DataFrame:
        held = {k[0]: v[0] for k, v in self.open.iterator()} | {k[0]: v[0] for k, v in self.final.iterator()}
        video = {k[0]: v[1] for k, v in self.video.iterator()}
        covered = {video[s] for s, status in held.items() if status in HOLDS and s in video}
        return pd.DataFrame([(key[0], len(held), len({*video.values()}), len(covered))], columns=["code", "instances", "distinct_videos", "covered_videos"])

    _ended = _records


def live_snapshot(writes: DataFrame, late: str = "2 hours") -> DataFrame:
    """(code, instances, distinct_videos, covered_videos) of every session, as session_snapshot counts them.

    On a stream, a batch gives the sessions that it changed. State is the last record of each scene and ends with the session,
    so it follows scenes, not writes.
    """
    if not writes.isStreaming:
        return session_snapshot(session_records(writes))
    own = writes if "kind" in writes.columns else writes.withColumn("kind", F.lit("write"))
    out = "code int, instances bigint, distinct_videos bigint, covered_videos bigint"
    return own.withWatermark("ts", late).groupBy("code").transformWithStateInPandas(statefulProcessor=SnapshotFold(), outputStructType=out, outputMode="Update", timeMode="EventTime")


def _tag(checkpoint: str, number: int) -> str:
    """Names a micro-batch of one query."""
    return f"{checkpoint.rstrip('/').rsplit('/', 1)[-1]}-{number}"


HELD = "code int, scene_id bigint, status string, video_id string"


def held_table(spark: SparkSession, path: str, parts: int = 64) -> KeyedTable:
    """The records of live sessions, laid out by session."""
    return KeyedTable(spark, path, spark.createDataFrame([], HELD).schema, ["code"], parts)


def keep_held(writes: DataFrame, table: KeyedTable, checkpoint: str, late: str = "2 hours"):
    """Keeps `table` up to date with a stream of writes: each batch replaces the records of the sessions that it changed, and
    drops those that have ended. A batch that is run again changes nothing. Returns the query."""

    def write(batch: DataFrame, number: int) -> None:
        batch = stored(batch)
        table.replace_for(batch.where("scene_id is not null"), batch.select("code"), batch=_tag(checkpoint, number))

    return session_stream(writes, late).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def job_state_stream(events: DataFrame) -> DataFrame:
    """The current stage of each video and its failures; unknown stages are no events."""
    return events.where(F.col("stage").isin(STAGES)).groupBy("video_id").agg(F.max_by("stage", F.struct("ts", "event_id")).alias("stage"), F.count_if(F.col("stage") == "FAILED").alias("failures"))


def event_windows(events: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "10 minutes", once: list[str] | None = None) -> DataFrame:
    """Counts per window and type, on a stream (late rows drop after the watermark) or a table.

    With `slide` windows overlap; `once` names the key by which repeated events count once within the watermark.
    """
    x = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    if once:
        x = x.dropDuplicatesWithinWatermark(once) if events.isStreaming else x.dropDuplicates(once)
    return x.groupBy(F.window("ts", size, slide), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def session_windows(events: DataFrame, gap: str = "2 hours", late: str = "2 hours") -> DataFrame:
    x = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return x.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), "user_id", "n")


def incremental_enrich(source: DataFrame, target: KeyedTable, transform: Callable[[DataFrame], DataFrame], keys: list[str], checkpoint: str, failures: KeyedTable | None = None, attempts: int = 3):
    """A re-runnable enrichment: each micro-batch adds only rows of keys that the target has not; returns the query.

    `transform` gives the target's columns and, where a row can fail, `error`: null for rows that are done, empty output included. A
    row that fails goes with its error and the number of its attempts to `failures` (the source's columns, error, attempts), stays
    pending, and is tried again with later batches, up to `attempts` times. Both tables are changed by partition under the
    batch's id, so a batch that fails halfway and runs again repeats nothing.
    """

    def write(batch: DataFrame, number: int) -> None:
        columns, tag = batch.columns, _tag(checkpoint, number)
        todo = batch.withColumn("attempts", F.lit(0))
        if failures is not None:
            again = failures.read().where(F.col("attempts") < attempts)
            todo = todo.unionByName(again.select(*columns, "attempts"))
        todo = stored(latest(todo, keys, ["attempts"]).join(target.read().select(keys), keys, "left_anti"))
        new = transform(todo.select(columns))
        new = stored(new if "error" in new.columns else new.withColumn("error", F.lit(None).cast("string")))
        if failures is not None:  # before the target: rows that are done there are not tried again
            failed = new.where("error is not null").select(*keys, "error")
            failures.replace_for(todo.join(failed, keys).withColumn("attempts", F.col("attempts") + 1), todo.select(keys), batch=tag)
        target.append_new(new.where("error is null"), keys, batch=tag)

    return source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
