"""The whole corpus: words late in a text and documents without a vector are found, no vector is left out."""

from datetime import datetime

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from shotweave.operators import retrieve as R
from shotweave.operators.encode import embed_texts, hash_encoder
from shotweave.operators.querylog import parse_log
from shotweave.operators.search import search_log, search_sequence, stage_results
from shotweave.plans import registry, whole
from shotweave.plans.fixtures import derived_corpus


@pytest.fixture
def small(spark, tmp_path):
    """Vectors 0..39, documents 0..59: document 5 ends in a rare word after 5,000 characters, 50 has it and no vector."""
    late = "word " * 1000 + "zebra crossing"
    tables = {
        "embeddings": spark.range(40).select(F.col("id").alias("vec_id"), F.array(*[F.sin(F.col("id") * k + 1).cast("float") for k in range(1, 9)]).alias("embedding"), F.lit(0).alias("label")),
        "documents": spark.createDataFrame([(i, late if i in (5, 48, 50) else "word") for i in range(60)], "doc_id long, text string"),
        "conversations": spark.createDataFrame([(1, 0, "user", "hi")], "conv_id long, turn long, role string, text string"),
        "events": spark.createDataFrame([(1, datetime(2024, 1, 1), 1, "view")], "event_id long, ts timestamp, user_id long, event_type string"),
        "pages": spark.createDataFrame([(0, "u", "h")], "page_id long, url string, html string"),
    }
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_whole_texts_and_vectors(spark, small):
    t = derived_corpus(spark, small)
    q = spark.createDataFrame([(1, ["zebra"]), (2, ["zebra"]), (3, ["crossing", "none"]), (4, ["none"])], "query_id int, tokens array<string>")
    got = {(r.query_id, r.keyframe_id) for r in R.retrieve_ocr(q, t).collect()}
    assert got == {(n, k) for n in (1, 2, 3) for k in (5, 48, 50)}
    gone = spark.createDataFrame([(1, "00000")], "query_id int, video_id string")
    assert {(r.query_id, r.keyframe_id) for r in R.retrieve_ocr(q, t, exclude=gone).collect()} == got - {(1, 5)}
    assert t["keyframe_embedding"].count() == 40 and t["keyframes"].count() == 61
    assert t["keyframe_caption"].where("keyframe_id = 48 and caption like '%zebra%'").count() == 1


def test_vector_search_holds_the_nearest_of_all(spark):
    """Recall at 20 against a ranking in numpy, for the ids divisible by 20; 1000 sign codes do not hold all of them."""
    d = "/root/testdata/sf0.1"
    x = pq.read_table(f"{d}/embeddings.parquet").sort_by("vec_id")
    ids, v = x["vec_id"].to_numpy(), np.stack(x["embedding"].to_numpy()).astype(float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    asked = np.flatnonzero(ids % 20 == 0)
    far = np.round(1 - v[asked] @ v.T, 6)
    want = {int(ids[a]): {int(ids[j]) for j in np.lexsort((ids, f))[:20]} for a, f in zip(asked, far, strict=True)}
    t = derived_corpus(spark, d)
    q = t["keyframe_embedding"].where("keyframe_id % 20 = 0").withColumnRenamed("keyframe_id", "query_id")
    got = {}
    for r in R.retrieve_visual(q, t, 20).collect():
        got.setdefault(r.query_id, set()).add(r.keyframe_id)
    assert len(want) == 100 and np.mean([len(want[a] & got[a]) / 20 for a in want]) > 0.999


def test_query_log_takes_long_strings(spark):
    raw = "word " * 20_000 + '>> (9) next text:"a >> b"'
    stages = parse_log(spark.createDataFrame([(1, raw)], "query_id int, raw string"))[0].orderBy("stage").collect()
    assert [len(s.free_text) for s in stages] == [99_999, 4] and (stages[1].ocr_phrase, stages[1].gap_ms) == ("a >> b", 9000)


def test_whole_queries_read_every_row(spark):
    d, q = "/root/testdata/sf0.001", registry.QUERIES
    t = derived_corpus(spark, d)
    assert q["query_words"](spark, d).count() == t["transcript_segment"].count()
    assert q["keyframe_index"](spark, d).count() == t["keyframes"].count()
    assert q["query_stages"](spark, d).select("query_id").distinct().count() == t["transcript_segment"].count()
    assert registry.QUERIES["scene_counts"](spark, d).agg(F.sum("scenes")).first()[0] == registry.embedded(t).select("scene_id").distinct().count()


def test_each_stage_searches_its_own_text(spark):
    """Scenes 0, 1, 2 of one video say alpha, beta, gamma; gaps and numbers of stages differ by query."""
    kf = spark.createDataFrame([(i * 4, i, "00000", 0, i * 8000) for i in range(3)], "keyframe_id long, scene_id long, video_id string, kf_index int, ts_ms int")
    t = {
        "keyframes": kf,
        "keyframe_text": spark.createDataFrame([(0, "alpha"), (4, "beta"), (8, "gamma ray")], "keyframe_id long, ocr_text string"),
        "scenes": kf.select("scene_id", "video_id", F.col("ts_ms").alias("start_ms"), (F.col("ts_ms") + 8000).alias("end_ms")),
        "videos": spark.createDataFrame([("00000", "V3C1")], "video_id string, collection string"),
        "keyframe_embedding": spark.createDataFrame([], "keyframe_id long, model_id int, embedding array<float>"),
        "caption_embedding": spark.createDataFrame([], "keyframe_id long, model_id int, embedding array<float>"),
        "transcript_embedding": spark.createDataFrame([], "segment_id long, model_id int, embedding array<float>"),
        "transcript_segment": spark.createDataFrame([(9, "00000", 17000, 20000, "hello there")], "segment_id long, video_id string, start_ms int, end_ms int, text string"),
    }
    raw = [(1, "alpha >> (9) beta"), (2, "alpha >> (7) beta"), (3, 'alpha >> (9) beta >> (9) text:"gamma ray"'), (4, "beta >> (9) said:hello there"), (5, "alpha"), (6, "alpha >> (9) beta -video:00000")]
    stages, gone = parse_log(spark.createDataFrame(raw, "query_id int, raw string"))
    stages = embed_texts(stages, "free_text", hash_encoder(), 1).withColumn("text_embedding", F.col("embedding"))
    hits = {(r.query_id, r.stage, r.keyframe_id) for r in stage_results(stages, t).collect()}
    assert {(1, 0, 0), (1, 1, 4), (3, 2, 8), (4, 1, 8), (5, 0, 0)} <= hits and (1, 1, 0) not in hits
    chains = {(r.query_id, tuple(p.keyframe_id for p in r.path)) for r in search_sequence(stages, t, exclude=gone).collect()}
    assert chains == {(1, (0, 4)), (3, (0, 4, 8)), (4, (4, 8))}


def test_a_request_log_is_gated_routed_and_filtered(spark):
    """Two videos say the same; requests ask for a collection, a source, or leave a video out."""
    kf = spark.createDataFrame([(0, 0, "a", 0, 0), (4, 1, "b", 0, 0)], "keyframe_id long, scene_id long, video_id string, kf_index int, ts_ms int")
    vector = hash_encoder()
    texts = spark.createDataFrame([(0, "red door"), (4, "red door")], "keyframe_id long, ocr_text string")
    vectors = embed_texts(texts, "ocr_text", vector, 7).select("keyframe_id", "model_id", "embedding")
    none = spark.createDataFrame([], "keyframe_id long, model_id int, embedding array<float>")
    t = {
        "keyframes": kf, "keyframe_text": texts, "keyframe_embedding": vectors.unionByName(vectors.withColumn("model_id", F.lit(1)).where("keyframe_id = 4")), "caption_embedding": none,
        "scenes": kf.select("scene_id", "video_id", F.col("ts_ms").alias("start_ms"), (F.col("ts_ms") + 8000).alias("end_ms")),
        "videos": spark.createDataFrame([("a", "V3C1"), ("b", "MVK")], "video_id string, collection string"),
        "transcript_embedding": none.withColumnRenamed("keyframe_id", "segment_id"),
        "transcript_segment": spark.createDataFrame([], "segment_id long, video_id string, start_ms int, end_ms int, text string"),
    }
    rows = [(1, "red door", None, None, []), (2, "red door", None, " mvk ", []), (3, "red door -video:b", ["ocr"], None, []), (4, "red door", ["asr"], None, []), (5, 'text:"red door"', ["asr"], None, ["a"]), (6, "red door", ["visual"], "v3c1", [])]
    log = spark.createDataFrame(rows, "query_id int, raw string, sources array<string>, collection string, exclude array<string>")
    models = spark.createDataFrame([(7, "base"), (1, "other")], "model_id int, name string")
    add = lambda stages: embed_texts(stages.withColumnRenamed("model_id", "m"), "free_text", vector, 0).drop("model_id").withColumnRenamed("m", "model_id").withColumn("text_embedding", F.col("embedding"))
    results, chains = search_log(log, t, add, models, "V3C1:other", "base")
    got = {}
    for r in results.collect():
        got.setdefault(r.query_id, []).append(r.video_id)
    assert {q: sorted(v) for q, v in got.items()} == {1: ["a", "b"], 2: ["b"], 3: ["a"], 5: ["b"]}  # 6: no vector of that model in V3C1
    assert chains.count() == 0


def test_searches_join_by_tokens_and_compare_vectors_in_blocks(spark):
    """No text or vector search is a nested loop or a product of two tables."""
    d = "/root/testdata/sf0.001"
    for name in ("retrieve_ocr", "retrieve_ocr_phrase", "phrase_in_transcripts", "similar_transcripts", "knn_hamming", "retrieve_visual", "search_two_signal"):
        plan = registry.QUERIES[name](spark, d)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "CartesianProduct" not in plan, name
