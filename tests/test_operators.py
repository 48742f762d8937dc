"""Golden cases of the retrieval operators, and every registered query against its SQL twin."""

import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from shotweave.functions.media import keyframe_count, timecode_to_ms
from shotweave.functions.text import cover_rank, distinctive_tokens, trigram_similarity
from shotweave.operators.querylog import parse_log
from shotweave.operators.ranking import rrf_fuse
from shotweave.operators.search import link_chains
from shotweave.operators.sessions import session_records
from shotweave.plans import registry
from shotweave.sources.corpus import normalize_probe, read_manifest

DATA = "/root/testdata/sf0.001"


def one(spark, expr):
    return spark.range(1).select(expr).first()[0]


def test_fusion_adds_weighted_reciprocal_ranks(spark):
    rows = [(1, "visual", 1, 10, 100), (1, "ocr", 2, 10, 100), (1, "visual", 2, 11, 101), (1, "off", 1, 12, 102), (1, "visual", 3, 13, None)]
    ranked = spark.createDataFrame(rows, "query_id int, retriever string, rank int, scene_id long, keyframe_id long")
    out = rrf_fuse(ranked, {"ocr": 4.0, "off": 0.0}).orderBy("rank").collect()
    assert [r.keyframe_id for r in out] == [100, 101]
    assert math.isclose(out[0].score, 1 / 61 + 4 / 62)
    assert out[0].signals == {"visual": 1, "ocr": 2}


def test_chains_prefer_the_best_successor_inside_the_window(spark):
    rows = [(1, 0, "v", 1, 1, 0, 1.0), (1, 1, "v", 2, 2, 5000, 0.5), (1, 1, "v", 3, 3, 9000, 0.9), (1, 1, "v", 4, 4, 10000, 5.0), (1, 1, "v", 1, 5, 100, 9.0), (1, 0, "w", 9, 9, 0, 1.0)]
    hits = spark.createDataFrame(rows, "query_id int, stage int, video_id string, scene_id long, keyframe_id long, ts_ms int, score double")
    out = link_chains(hits, [10000]).collect()
    assert [([p.keyframe_id for p in r.path], r.gaps_ms, r.reached) for r in out] == [([1, 3], [9000], 1.9)]


def test_query_log(spark):
    log = spark.createDataFrame([(1, 'a man text:"x >> y" >> (d500ms) said:hi there -video:00003 >> '), (2, ""), (3, "a >> b >> (9999) c >> d >> e")], "query_id int, raw string")
    stages, gone = parse_log(log)
    got = {(r.query_id, r.stage): (r.free_text, r.ocr_phrase, r.asr_phrase, r.gap_ms) for r in stages.collect()}
    assert got[1, 0] == ("a man", "x >> y", None, None) and got[1, 1] == ("", None, "hi there", 500) and (1, 2) not in got
    assert got[2, 0] == ("", None, None, None)
    assert got[3, 2][3] == 600_000 and got[3, 1][3] == 60_000 and (3, 4) not in got
    assert [tuple(r) for r in gone.collect()] == [(1, "00003")]


@pytest.mark.parametrize(
    "raw, free, ocr, asr, gone",
    [
        ('context: foo text:bare phrase said:"Q A" end -video:1 --exclude: 2, 3,4 tail', "context: foo end tail", "bare phrase", "Q A", {"1", "2", "3", "4"}),
        ('TEXT: "One" text:two', "", "One", None, set()),
        ("said: -video:7x foo", "foo", None, None, {"7x"}),
        ('text:"" said:""', "", None, None, set()),
        ("foo-video:3 bar -video:3", "foo bar", None, None, {"3"}),
        ('"a >> b" c', '"a >> b" c', None, None, set()),
    ],
)
def test_pieces_of_a_stage(spark, raw, free, ocr, asr, gone):
    stages, out = parse_log(spark.createDataFrame([(1, raw)], "query_id int, raw string"))
    assert [(r.free_text, r.ocr_phrase, r.asr_phrase) for r in stages.collect()] == [(free, ocr, asr)] and {r.video_id for r in out.collect()} == gone


def test_text_and_media_rules(spark):
    assert one(spark, F.round(trigram_similarity(F.lit("B0ULANGERIE DUPONT"), F.lit("BOULANGERIE DUPONT")), 3)) == 0.727
    assert [one(spark, F.round(cover_rank(F.lit(n)), 4)) for n in (1, 2)] == [0.0909, 0.1667]
    assert [one(spark, keyframe_count(F.lit(ms))) for ms in (0, 3000, 8001, 120000, 2340000)] == [2, 2, 3, 30, 32]
    assert [one(spark, timecode_to_ms(F.lit(s))) for s in ("01:02:03.500", "02:03,5", "x")] == [3723500, 123500, None]
    assert one(spark, distinctive_tokens(F.lit("a man past a bakery with a sign reading Boulangerie Dupont"))) == ["boulangerie", "dupont"]


def test_session_fold_never_downgrades(spark):
    rows = [(1, 1, 7, "v", "CORRECT"), (2, 1, 7, None, None), (3, 1, 7, None, "WRONG"), (4, 1, None, "v", "WRONG"), (5, 1, 8, "w", None)]
    writes = spark.createDataFrame(rows, "event_id long, code int, scene_id long, video_id string, status string").withColumn("ts", F.timestamp_seconds("event_id"))
    assert {(r.scene_id, r.status, r.video_id) for r in session_records(writes).collect()} == {(7, "WRONG", "v"), (8, "INDETERMINATE", "w")}


def test_file_sources(spark, tmp_path):
    (tmp_path / "m.txt").write_text("# list\n\n00001\thttp://a/b.mp4\n/x/00002.part.mkv\n")
    assert sorted(tuple(r) for r in read_manifest(spark, str(tmp_path / "m.txt"), "V3C1").collect()) == [("00001", "V3C1", "http://a/b.mp4"), ("00002", "V3C1", "/x/00002.part.mkv")]
    probes = spark.createDataFrame([("a", '{"streams":[{"codec_type":"video","avg_frame_rate":"0/0","r_frame_rate":"25/1"},{"codec_type":"audio"}],"format":{"duration":"2.5"}}'), ("b", '{"streams":[]}')], "video_id string, json string")
    rows = {r.video_id: r for r in normalize_probe(probes).collect()}
    assert (rows["a"].fps, rows["a"].duration_ms, rows["a"].has_audio, rows["a"].ok) == (25.0, 2500, True, True) and not rows["b"].ok


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{DATA}/{f}')")
    return c


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = registry.queries()[name](spark, DATA)
    found = duck.execute(registry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    plain = lambda rows: sorted(repr([round(x, 9) if isinstance(x, float) else x for x in r]) for r in rows)
    order = [names.index(c) for c in df.columns]
    assert plain(df.collect()) == plain([r[i] for i in order] for r in found.fetchall())


def test_entry(spark):
    assert registry.entry(spark).count() > 0
