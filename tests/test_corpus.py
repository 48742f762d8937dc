"""The corpus reader, its writers and rules, work lists, time codes and live sessions."""

from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from shotweave.functions import media
from shotweave.functions.text import fold_text
from shotweave.operators import browse as B
from shotweave.operators import sessions as S
from shotweave.operators.ingest import stage_reports
from shotweave.plans.fixtures import derived_corpus
from shotweave.plans.registry import WORDS
from shotweave.sources import corpus as C
from shotweave.sources import scratch
from shotweave.streaming.jobs import event_windows, live_snapshot


def empty(spark):
    return {name: spark.createDataFrame([], columns) for name, columns in C.SCHEMAS.items()}


def test_reader_gives_declared_columns(spark, tmp_path):
    for name, df in empty(spark).items():
        df.write.parquet(f"{tmp_path}/{name}")
    spark.createDataFrame([("00001", "V3C1", 25.0, 1000)], "video_id string, collection string, fps double, duration_ms int").write.mode("overwrite").parquet(f"{tmp_path}/videos")
    t = C.read_corpus(spark, str(tmp_path))
    assert {n: df.columns for n, df in t.items()} == {n: df.columns for n, df in empty(spark).items()}
    assert t["videos"].first().width is None and C.violations(t).select("rule").distinct().count() == 1  # has_audio is null
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        C.read_corpus(spark, str(tmp_path / "none"))["videos"].count()


def test_writers(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, at int")
    new = spark.createDataFrame([(2, "c", 3), (2, "d", 2), (3, "x", 1), (3, "y", 1)], "k int, v string, at int")
    assert sorted(map(tuple, C.upsert(old, new, ["k"], ["at"]).collect())) == [(1, "a", 1), (2, "c", 3), (3, "y", 1)]
    assert sorted(map(tuple, C.append_new(old, new, ["k"], ["at"]).collect())) == [(3, "y", 1)]
    gone = spark.createDataFrame([(1,), (3,)], "k int")
    assert sorted(map(tuple, C.replace_for(old, new.where("k = 3"), ["k"], gone).collect())) == [(2, "b", 1), (3, "x", 1), (3, "y", 1)]
    assert C.upsert(old, new.limit(0), ["k"]).count() == 2


def test_rules_and_cascade(spark):
    t = empty(spark) | {
        "videos": spark.createDataFrame([("a", "V3C1", 0.0, 1000, None, None, True, None), ("b", None, 25.0, 500, None, None, True, None)], C.SCHEMAS["videos"]),
        "scenes": spark.createDataFrame([(1, "a", 0, 5, 4, 0, 10), (2, "a", 0, 0, 4, 10, 5), (3, "z", -1, 0, 1, 0, 1)], C.SCHEMAS["scenes"]),
        "keyframes": spark.createDataFrame([(1, 1, "a", 0, 1, 1), (2, 1, "a", 0, 2, 2), (3, 9, "b", 0, 1, 1)], C.SCHEMAS["keyframes"]),
        "keyframe_text": spark.createDataFrame([(1, "x"), (8, "y")], C.SCHEMAS["keyframe_text"]),
        "ingest_jobs": spark.createDataFrame([("a", "V3C1", "u", "NOWHERE", 0, None, None, None, datetime(2024, 1, 1))], C.SCHEMAS["ingest_jobs"]),
        "transcript_segment": spark.createDataFrame([(1, "b", 0, 600, "hi", None)], C.SCHEMAS["transcript_segment"]),
    }
    got = {(r.rule, r.table, r.key) for r in C.violations(t).collect()}
    assert got == {
        ("fps", "videos", "a"), ("collection is null", "videos", "b"), ("frame order", "scenes", "1"), ("time order", "scenes", "2"), ("shot_index below 0", "scenes", "3"), ("no videos", "scenes", "3"),
        ("unique video_id, shot_index", "scenes", "1"), ("unique scene_id, kf_index", "keyframes", "1"), ("no scenes", "keyframes", "3"), ("no keyframes", "keyframe_text", "8"), ("stage", "ingest_jobs", "a"), ("past the end", "transcript_segment", "1"),
    }
    left = C.cascade(t, "videos", spark.createDataFrame([("a",)], "video_id string"))
    assert {n: left[n].count() for n in ("videos", "scenes", "keyframes", "keyframe_text", "transcript_segment")} == {"videos": 1, "scenes": 0, "keyframes": 0, "keyframe_text": 0, "transcript_segment": 1}


def test_probe_rows_without_a_video_are_told(spark):
    rows = [("a", '{"streams":[{"codec_type":"video","avg_frame_rate":"30000/1001","nb_frames":"90"}],"format":{"duration":"3"}}'), ("b", '{"streams":[{"codec_type":"video","avg_frame_rate":"25/1"}],"format":{}}'), ("c", "junk"), ("d", '{"streams":[{"codec_type":"video","avg_frame_rate":"25/1","duration":"2"}]}')]
    probes = spark.createDataFrame(rows, "video_id string, json string")
    assert {r.video_id: r.frames for r in C.normalize_probe(probes).where("ok").collect()} == {"a": 90, "d": 50}
    assert {tuple(r) for r in C.probe_errors(probes).collect()} == {("b", "no duration"), ("c", "no video stream")}


def one(spark, *columns):
    return list(spark.range(1).select(*columns).first())


def test_time_codes(spark):
    assert one(spark, *[media.parse_timecode(F.lit(s)) for s in ("1:02:03.5", "90:00", "1:60:00", "0:60", " 02:03,05 ", "x", "")]) == [3723500, 5400000, None, None, 123050, None, None]
    assert one(spark, *[media.format_timecode(F.lit(ms)) for ms in (0, 65_432, 59_996, 3_600_000, -5)]) == ["00:00.00", "01:05.43", "01:00.00", "1:00:00.00", "00:00.00"]
    assert one(spark, *[media.format_duration(F.lit(x)) for x in (42.4, 3522.0, 3900.0, None)]) == ["42s", "58m 42s", "1h 05m", "0s"]
    assert one(spark, *[media.format_gap(F.lit(x)) for x in (12_400, 65_000, None)]) == ["+12s", "+1m 05s", "+0s"]
    assert one(spark, media.keyframe_ms(F.lit(None).cast("double"), F.lit(50), F.lit(25.0)), media.keyframe_ms(F.lit(7.5), F.lit(50), F.lit(25.0))) == [2000, 8]
    assert tuple(one(spark, media.scene_candidates(F.lit(25), F.lit(60), F.lit(12), F.lit(9)))[0]) == (4, 6)
    assert one(spark, *[media.looks_damaged(F.lit(s)) for s in ("x no frame! y", "fine", None)]) == [True, False, False]
    assert one(spark, media.keep_decode(F.lit(98), F.lit(100), F.lit(False)), media.keep_decode(F.lit(50), F.lit(100), F.lit(True)), media.keep_decode(F.lit(50), F.lit(100), F.lit(None).cast("boolean"))) == [True, True, False]
    assert one(spark, *[media.verdict_state(F.lit(v), F.lit(c)) for v, c in (("CORRECT", 500), ("WRONG", 200), (None, 202), (None, 204), (None, 404))]) == ["success", "error", "pending", "success", "error"]
    assert one(spark, fold_text(F.lit("ČÉŁØ Straße cafe\u0301 Ǹ ở"))) == ["celo strasse cafe n o"]


def test_work_lists(spark):
    d = derived_corpus(spark, "/root/testdata/sf0.001")
    every = B.pending_work(d, "vectors").count()
    assert sum(B.pending_work(d, "vectors", part=(i, 3)).count() for i in range(3)) == every > 0
    assert sum(B.pending_work(d, "vectors", collection=c).count() for c in ("V3C1", "v3c2", " MVK ")) == every
    assert B.pending_work(d, "text", scope="shot").count() < B.pending_work(d, "text").count()
    assert {r.stage: r.n for r in B.pending_counts(d, ["vectors"]).collect()} == {"vectors": every}
    assert B.shard(d["videos"], "video_id", 0, 2).count() + B.shard(d["videos"], "video_id", 1, 2).count() == d["videos"].count()
    with pytest.raises(ValueError):
        B.in_scope(d["keyframes"], "none")
    assert stage_reports(d).where("stage = 'transcripts' and status = 'skipped'").count() == 1 and len(WORDS) == 3


def test_farthest_points(spark):
    kf = spark.createDataFrame([(i, 1, i * 10) for i in range(4)] + [(9, 2, 0)], "keyframe_id long, scene_id long, ts_ms int")
    v = spark.createDataFrame([(0, [0.0, 0.0]), (1, [1.0, 0.0]), (2, [1.1, 0.0]), (3, [9.0, 0.0]), (9, [1.0, 1.0])], "keyframe_id long, embedding array<double>")
    assert {tuple(r) for r in B.farthest_point_select(v, kf).collect()} == {(1, 2, 0), (1, 3, 1), (2, 9, 0)}


def test_live_sessions_and_windows(spark):
    at = lambda h, m=0: datetime(2024, 1, 1, h, m, tzinfo=timezone.utc)
    activity = spark.createDataFrame([(1, at(8), "write"), (1, at(9, 59), "list"), (2, at(8, 1), "get"), (3, at(9), "peek"), (4, at(8), "join")], "code int, ts timestamp, kind string")
    got = {r.code: r.expires_in_ms for r in S.live_sessions(activity, F.lit(at(10)).cast("timestamp_ltz")).collect()}
    assert got == {1: 0, 2: 60_000, 4: 0}
    writes = spark.createDataFrame([(1, 1, 7, "v", "CORRECT"), (2, 1, 7, None, None), (3, 1, 8, "v", "WRONG"), (4, 1, 9, "w", None), (5, 2, None, "x", None)], "event_id long, code int, scene_id long, video_id string, status string").withColumn("ts", F.timestamp_seconds("event_id"))
    assert [tuple(r) for r in live_snapshot(writes).collect()] == [(1, 3, 2, 2)]
    events = spark.createDataFrame([(1, at(8, 10), "x"), (1, at(8, 10), "x"), (2, at(8, 40), "x")], "event_id long, ts timestamp, event_type string")
    assert sorted(r.n for r in event_windows(events, "1 hour", "30 minutes", once=["event_id"]).collect()) == [1, 1, 2]


def test_scratch_tables_can_be_dropped(spark):
    df = scratch.stored(spark.range(3).toDF("id"))
    assert df.count() == 3 and scratch.drop_stored(spark) >= 1
    with pytest.raises(Exception, match="FILE_NOT_EXIST|PATH_NOT_FOUND|does not exist"):
        df.count()
