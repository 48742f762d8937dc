"""Golden cases of the ingest jobs and request rules, with nulls, empty tables and blanks."""

import numpy as np
from pyspark.sql import functions as F

from shotweave.operators import ingest as N
from shotweave.operators import routing as T
from shotweave.operators import rules as U
from shotweave.operators.encode import embed_texts, hash_encoder


def test_shot_boundaries(spark, tmp_path):
    texts = {
        "tab.scenes.txt": "startframe\tx\tendframe\ty\n0\ta\t50\tb\n50\ta\t40\tb\n45\ta\t100\tb\n",
        "plain.txt": "# note\n\n0 25\n26 50\nbad line\n51 x\n51 75\n",
        "time.csv": "00:00:00.000,00:01.500\n00:01.500,00:00:02,040\n00:00:02.040,00:00:03.000\n",
        "sec.tsv": "0.0\t1.5\n1.5\t2.1\n",
        "head.txt": "start end\n",
        "none.txt": "one\n",
        "past.txt": "5000 6000\n",
    }
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    videos = spark.createDataFrame([(n.split(".")[0], 25.0, 10000) for n in texts] + [("null", 25.0, 1)], "video_id string, fps double, duration_ms int")
    files = N.read_boundary_files(spark, str(tmp_path)).unionByName(spark.createDataFrame([("null", None)], "video_id string, text string"))
    shots, warnings = N.parse_shot_boundaries(files, videos)
    got = {}
    for r in shots.orderBy("video_id", "shot_index").collect():
        got.setdefault(r.video_id, []).append((r.start_frame, r.end_frame, r.start_ms, r.end_ms))
    assert got["tab"] == [(0, 50, 0, 2000), (45, 100, 1800, 4000)]
    assert got["plain"] == [(0, 25, 0, 1000), (26, 50, 1040, 2000), (51, 75, 2040, 3000)]
    assert got["time"][0] == (0, 38, 0, 1500) and got["sec"] == [(0, 38, 0, 1500), (38, 52, 1500, 2100)]
    warned = {(r.video_id, r.line, r.problem) for r in warnings.collect()}
    assert {("tab", 2, "end before start"), ("tab", 3, "overlaps the shot before"), ("head", None, "only a header"), ("none", None, "no lines"), ("null", None, "no lines"), ("past", None, "shots past the end"), ("plain", 3, "unreadable"), ("plain", 4, "unreadable")} <= warned
    assert N.parse_shot_boundaries(files.limit(0), videos)[0].count() == 0


def test_sources_models_and_labels(spark):
    asked = spark.createDataFrame([(1, None, "a"), (2, [], " B "), (3, [" OCR", "zzz"], None), (4, ["zzz"], "c")], "query_id int, sources array<string>, collection string")
    got = {}
    for r in U.gate_sources(asked).collect():
        got.setdefault(r.query_id, set()).add(r.retriever)
    every, phrases = {*U.GATED, *U.PHRASES}, {*U.PHRASES}
    assert got == {1: every, 2: every, 3: {"ocr"} | phrases, 4: phrases}
    models = spark.createDataFrame([(1, "base"), (2, "m2")], "model_id int, name string")
    assert {r.query_id: r.model_id for r in U.route_model(asked, models, "A:m2,b: m2 ,c:none,junk", "base").collect()} == {1: 2, 2: 2, 3: 1, 4: 1}
    stages = spark.createDataFrame([(1, 0, "a man", "x", None), (1, 1, "", None, "hi")], "query_id int, stage int, free_text string, ocr_phrase string, asr_phrase string")
    assert [r.label for r in T.stage_label(stages).orderBy("stage").collect()] == ['text:"x" a man', 'said:"hi"']


def test_files_lines_and_fallbacks(spark):
    videos = spark.createDataFrame([("a",), ("b",), ("c",)], "video_id string")
    files = spark.createDataFrame([("raw/a.mkv",), ("raw/a.mp4",), ("data/b.x.mov",), ("data/a.mp4",), ("other/c.mp4",), ("raw/c.txt",)], "path string")
    assert {r.video_id: r.path for r in N.source_file(videos, files, ["raw", "data"]).collect()} == {"a": "raw/a.mp4", "b": "data/b.x.mov", "c": None}
    lines = F.array(*[F.struct(F.lit(t).alias("text"), F.lit(c).alias("confidence")) for t, c in ((" A ", 0.5), ("low", 0.49), ("  ", 0.9), ("b", 0.9), (None, 0.9))])
    row = spark.range(1).select(N.ocr_lines(lines).alias("t"), N.ocr_lines(F.lit(None).cast("array<struct<text:string,confidence:double>>")).alias("n")).first()
    assert (row.t, row.n) == ("A b", "")
    scenes = spark.createDataFrame([(1, 0, 11), (2, 20, 30), (3, 40, 50)], "scene_id long, start_frame int, end_frame int")
    candidates = spark.createDataFrame([(2, 21, 3.0, True), (2, 25, 3.0, True), (2, 28, None, True), (3, 41, 1.0, True), (3, 44, 50.0, False)], "scene_id long, frame int, luma_std double, degenerate boolean")
    assert {tuple(r) for r in N.keyframe_fallbacks(scenes, candidates).collect()} == {(1, "middle", 5), (2, "textured", 21)}


def test_encoder_sink_and_stability(spark, tmp_path):
    df = spark.createDataFrame([(1, "red door"), (2, "red door"), (3, None), (4, "")], "id int, text string")
    calls = embed_texts(df, "text", hash_encoder(16), 10)
    rows = {r.id: r.embedding for r in calls.collect()}
    assert rows[1] == rows[2] and rows[3] is None and np.isclose(np.linalg.norm(rows[1]), 1) and len(rows[4]) == 16
    nested = df.select("id", F.array(F.struct("text")).alias("keyframes"))
    for kind in ("parquet", "json"):
        T.write_results(nested, str(tmp_path / kind), kind)
        assert spark.read.format(kind).load(str(tmp_path / kind)).count() == 4
    assert [tuple(r) for r in T.stability_check(df, df.where("id < 4")).collect()] == [(1, 4, "")]
    log = spark.createDataFrame([("v", 1), ("v", 1)], "video_id string, keyframe_id int")
    found = spark.createDataFrame([("v", 1), ("v", 2)], "video_id string, keyframe_id int")
    assert {(r.keyframe_id, r.submitted) for r in T.already_submitted(found, log).collect()} == {(1, True), (2, False)}
