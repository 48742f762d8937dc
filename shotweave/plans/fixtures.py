"""A corpus derived from the driver's tables: what the registered queries run on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shotweave.operators.textindex import TextIndex, index_name
from shotweave.sources.corpus import read
from shotweave.sources.scratch import shared_dir

#: Keyframes of pages, which are not processed yet, have ids from here on.
PAGES = 1_000_000


def _vid(c) -> F.Column:
    return F.format_string("%05d", c.cast("bigint"))


def _div(a, n: int):
    return F.floor(a / n).cast("bigint")


def derived_corpus(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The corpus tables of one directory; every column is derived, every row is used, texts are whole.

    Vectors, documents and pages are keyframes: those of documents have recognised text and, the first of a scene, a caption;
    those of vectors have a vector; those of pages have nothing yet. Conversations are the speech of the video of their number.
    """
    emb, docs, conv, events, pages = (read(spark, sf_dir, t) for t in ("embeddings", "documents", "conversations", "events", "pages"))
    v = F.col("vec_id")
    ids = emb.select("vec_id").unionByName(docs.where("doc_id is not null").select(F.col("doc_id").alias("vec_id"))).unionByName(pages.where("page_id is not null").select((F.col("page_id") + PAGES).alias("vec_id"))).distinct()
    kf = ids.select(v.alias("keyframe_id"), _div(v, 4).alias("scene_id"), _vid(_div(v, 20)).alias("video_id"), (v % 4).cast("int").alias("kf_index"), ((_div(v, 4) % 5) * 8000 + (v % 4) * 2000).cast("int").alias("ts_ms"))
    scenes = kf.select("scene_id", "video_id").distinct().withColumn("shot_index", (F.col("scene_id") % 5).cast("int"))
    scenes = scenes.withColumn("start_ms", F.col("shot_index") * 8000).withColumn("end_ms", F.col("start_ms") + 8000)
    n = F.col("video_id").cast("int")
    videos = kf.select("video_id").distinct().select(
        "video_id", F.when(n % 3 == 0, "V3C1").when(n % 3 == 1, "V3C2").otherwise("MVK").alias("collection"), F.lit(25.0).alias("fps"), F.lit(40000).alias("duration_ms"), (n % 4 != 3).alias("has_audio"), (n % 13 == 5).alias("damaged")
    )
    text = docs.where("doc_id is not null").select(F.col("doc_id").alias("keyframe_id"), (F.col("doc_id") % 4).alias("kf_index"), "text")
    segment = F.col("conv_id") * 8 + F.col("turn")
    count = emb.agg(F.count("*").alias("vectors"))  # one row
    segments = conv.select(segment.alias("segment_id"), _vid(F.col("conv_id")).alias("video_id"), (F.col("turn") * 5000).cast("int").alias("start_ms"), (F.col("turn") * 5000 + 7000).cast("int").alias("end_ms"), "text")
    spoken = segments.crossJoin(F.broadcast(count)).select("segment_id", (F.col("segment_id") % F.col("vectors")).alias("vec_id"))
    kinds = {"purchase": "CORRECT", "error": "WRONG", "click": "INDETERMINATE", "view": "UNDECIDABLE"}
    stages = {"signup": "PENDING", "view": "FETCHED", "click": "DECODED", "purchase": "LOADED", "error": "FAILED"}
    pick = lambda m: F.element_at(F.create_map(*[F.lit(x) for kv in m.items() for x in kv]), F.col("event_type"))
    scene = _div(F.col("event_id"), 1000)
    return {
        "keyframes": kf,
        "scenes": scenes,
        "videos": videos,
        "keyframe_embedding": emb.select(v.alias("keyframe_id"), F.lit(1).alias("model_id"), "embedding"),
        "keyframe_text": text.select("keyframe_id", F.col("text").alias("ocr_text")),
        "keyframe_caption": text.where("kf_index = 0").select("keyframe_id", F.col("text").alias("caption")),
        "caption_embedding": emb.where(v % 4 == 1).select((v - 1).alias("keyframe_id"), F.lit(10).alias("model_id"), "embedding"),
        "transcript_segment": segments,
        "transcript_embedding": spoken.join(emb, "vec_id").select("segment_id", F.lit(10).alias("model_id"), "embedding"),
        "submissions": events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").cast("int").alias("code"), scene.alias("scene_id"), _vid(_div(scene, 5)).alias("video_id"), pick(kinds).alias("status")),
        "job_events": events.select(_vid(F.col("user_id")).alias("video_id"), F.col("ts").cast("timestamp").alias("ts"), "event_id", pick(stages).alias("stage")),
        "query_vectors": emb.where(v % 20 == 0).select(v.cast("int").alias("query_id"), F.lit(1).alias("model_id"), "embedding"),
    }


_INDEXES: dict[str, TextIndex] = {}


def searchable(spark: SparkSession, sf_dir: str, speech: bool = False) -> dict:
    """The corpus with the stored index of its recognised texts and, if asked for, that of its speech.

    A session builds the index of a directory once, as long as the directory's files stay the same.
    """
    t = derived_corpus(spark, sf_dir)
    for name, key, text, source in [("keyframe_text", "keyframe_id", "ocr_text", "documents"), ("transcript_segment", "segment_id", "text", "conversations")][: 1 + speech]:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{source}.parquet")
        changed = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).getModificationTime()
        own = index_name(spark.sparkContext.applicationId, sf_dir, name, str(changed))
        if own not in _INDEXES:
            _INDEXES[own] = TextIndex(spark, f"{shared_dir(spark)}/{own}").append(t[name], key, text)
        t[f"{name}_index"] = _INDEXES[own]
    return t
