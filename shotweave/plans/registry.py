"""Registered queries of the library and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shotweave.functions import media
from shotweave.functions.text import cover_rank, distinctive_tokens, lexemes, trigram_similarity
from shotweave.functions.vectors import binary_quantize, cosine_distance, hamming, l2_normalize, parse_vector
from shotweave.operators import browse as B
from shotweave.operators import ingest as N
from shotweave.operators import retrieve as R
from shotweave.operators import routing as T
from shotweave.operators import rules as U
from shotweave.operators import sessions as S
from shotweave.operators.codeindex import CodeIndex
from shotweave.operators.encode import embed_texts, hash_encoder
from shotweave.operators.querylog import parse_log
from shotweave.operators.ranking import merge_signal_labels, page, rrf_fuse
from shotweave.operators.search import STAGES, enrich, filmstrip, link_chains, link_rows, search
from shotweave.plans.fixtures import derived_corpus, searchable
from shotweave.plans.oracles import ORACLES
from shotweave.sources import corpus as C
from shotweave.sources.keyed import KeyedTable
from shotweave.sources.scratch import shared_dir, stored
from shotweave.streaming.jobs import event_windows, incremental_enrich, live_snapshot, session_windows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
#: What queries search for: a list of words each, by the remainder of the query id.
WORDS = [["the", "der"], ["der", "que"], ["the", "que", "und"]]


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def request(t: dict[str, DataFrame], stage: int = 0) -> DataFrame:
    """The query table of the tests: every query vector with its words, which each stage of a sequence takes from the next list."""
    lists = F.array(*[F.array(*map(F.lit, words)) for words in WORDS])
    return t["query_vectors"].withColumn("tokens", F.get(lists, (F.col("query_id") + stage) % len(WORDS))).withColumn("phrase", F.array_join("tokens", " "))


def phrased(t: dict[str, DataFrame]) -> DataFrame:
    """Queries for a phrase of two words: every third one for another phrase."""
    first = F.when(F.col("query_id") % 3 == 0, "of").otherwise("in")
    return request(t).withColumn("tokens", F.array(first, F.lit("the")))


def flat(fused: DataFrame) -> DataFrame:
    return fused.select("query_id", "keyframe_id", "scene_id", F.round("score", 6).alias("score"), "rank")


def entry(spark: SparkSession) -> DataFrame:
    t = derived_corpus(spark, "/root/testdata/sf0.001")
    q = request(t)
    return enrich(search(q, t, ["visual", "ocr", "caption", "transcript"]), t).select("query_id", "rank", "keyframe_id", "scene_id", "video_id", "shot_index", "kf_index", "ts_ms", "score", "damaged")


def embedded(t: dict[str, DataFrame]) -> DataFrame:
    """Keyframes that have a vector: in these tables, those that are selected."""
    return t["keyframes"].join(t["keyframe_embedding"].select("keyframe_id"), "keyframe_id", "left_semi")


@query
def corpus_counts(spark, d):
    t = derived_corpus(spark, d)
    return B.content_counts(t, sorted(t))


@query
def corpus_violations(spark, d):
    return C.violations(derived_corpus(spark, d))


@query
def append_new(spark, d):
    t = derived_corpus(spark, d)
    emb = C.read(spark, d, "embeddings").select(F.col("vec_id").alias("keyframe_id"), F.lit(1).alias("model_id"))
    kf = t["keyframes"].select("keyframe_id", F.lit(1).alias("model_id"))
    return C.append_new(emb, kf.unionByName(kf), ["keyframe_id", "model_id"])


@query
def upsert_videos(spark, d):
    v = derived_corpus(spark, d)["videos"]
    return C.upsert(v, v.where("damaged").withColumn("duration_ms", F.col("duration_ms") + 1), ["video_id"]).select("video_id", "duration_ms", "damaged")


def keyed(spark: SparkSession, like: DataFrame, by: list[str]) -> KeyedTable:
    """An empty table in the shared folder."""
    return KeyedTable(spark, f"{shared_dir(spark)}/keyed-{uuid4().hex}", like.schema, by, 16)


@query
def committed_scenes(spark, d):
    """Shots after three commits to a table on disk: loaded, some changed, those of two videos replaced."""
    scenes = derived_corpus(spark, d)["scenes"]
    table = keyed(spark, scenes, ["video_id"])
    table.upsert(scenes, ["video_id", "scene_id"], batch="load")
    table.upsert(scenes.where("scene_id % 7 = 0").withColumn("end_ms", F.col("end_ms") + 1), ["video_id", "scene_id"], batch="change")
    table.upsert(scenes, ["video_id", "scene_id"], batch="load")  # a repeated batch changes nothing
    gone = spark.createDataFrame([("00003",), ("00004",)], "video_id string")
    table.replace_for(scenes.where("video_id = '00003' and shot_index < 2").withColumn("end_ms", F.col("end_ms") - 1), gone)
    return table.read().select("scene_id", "video_id", "end_ms")


@query
def enriched_stream(spark, d):
    """A stream of documents enriched by their length; texts with a '#' fail and stay pending."""
    docs = C.read(spark, d, "documents").where("doc_id is not null").select("doc_id", "text")
    source = f"{d}/documents.parque[t]"  # as a pattern, since the table can be one file, and streams read folders or patterns
    stream = spark.readStream.schema(C.read(spark, d, "documents").schema).parquet(source).where("doc_id is not null").select("doc_id", "text")
    measure = lambda x: x.select("doc_id", F.length(F.coalesce("text", F.lit(""))).alias("chars"), F.when(F.contains("text", F.lit("#")), "sign").alias("error"))
    done, failed = keyed(spark, measure(docs).drop("error"), ["doc_id"]), keyed(spark, docs.withColumn("error", F.lit("")).withColumn("attempts", F.lit(0)), ["doc_id"])
    incremental_enrich(stream, done, measure, ["doc_id"], f"{shared_dir(spark)}/stream-{uuid4().hex}", failed).awaitTermination()
    none = F.lit("")
    return done.read().select("doc_id", "chars", none.alias("error")).unionByName(failed.read().select("doc_id", F.lit(-1).alias("chars"), "error"))


@query
def replace_scenes(spark, d):
    t = derived_corpus(spark, d)
    new = t["scenes"].where("video_id = '00003' and shot_index < 2").withColumn("end_ms", F.col("end_ms") - 1)
    gone = t["videos"].where("video_id in ('00003', '00004')").select("video_id")  # the second one has no new scenes
    return C.replace_for(t["scenes"], new, ["video_id"], gone).select("scene_id", "video_id", "end_ms")


@query
def collection_filter(spark, d):
    t = derived_corpus(spark, d)
    gone = spark.range(1).select(F.lit(1).alias("query_id"), F.lit("00003").alias("video_id"))
    return R.allowed(t["keyframes"].withColumn("query_id", F.lit(1)), t["videos"], " v3c1 ", gone).select("keyframe_id", "video_id")


@query
def scope_and_shard(spark, d):
    return B.shard(B.in_scope(derived_corpus(spark, d)["keyframes"], "shot"), "keyframe_id", 0, 3).select("keyframe_id")


@query
def id_contains(spark, d):
    return derived_corpus(spark, d)["videos"].where(F.contains("video_id", F.lit("1"))).select("video_id")


@query
def media_paths(spark, d):
    t = derived_corpus(spark, d)
    x = t["keyframes"].join(t["scenes"].select("scene_id", "shot_index"), "scene_id")
    return x.select("keyframe_id", media.keyframe_path(F.col("video_id"), F.col("shot_index"), F.col("kf_index")).alias("path"), media.keyframe_path(F.col("video_id"), F.col("shot_index"), F.col("kf_index"), "thumbs").alias("thumb"))


@query
def segment_scenes(spark, d):
    t = derived_corpus(spark, d)
    return R.segment_scenes(t["transcript_segment"], t["scenes"]).select("segment_id", "scene_id")


@query
def pending_vectors(spark, d):
    t = derived_corpus(spark, d)
    return B.pending(t["keyframes"], t["keyframe_embedding"], ["keyframe_id"]).select("keyframe_id", "video_id")


@query
def pending_text(spark, d):
    t = derived_corpus(spark, d)
    return B.pending_work(t, "text")


@query
def pending_captions(spark, d):
    t = derived_corpus(spark, d)
    return B.pending_work(t, "captions", scope="shot", part=(1, 3))


@query
def pending_transcripts(spark, d):
    t = derived_corpus(spark, d)
    return B.pending_work(t, "transcripts", collection=" v3c1 ")


@query
def pending_text_vectors(spark, d):
    t = derived_corpus(spark, d)
    return B.pending_work(t, "caption_vectors", model_id=10)


@query
def pending_counts(spark, d):
    return B.pending_counts(derived_corpus(spark, d))


@query
def videos_complete(spark, d):
    t = derived_corpus(spark, d)
    done = t["keyframes"].join(t["keyframe_embedding"], "keyframe_id", "left_semi")
    return B.videos_complete(t["videos"], t["scenes"], done)


@query
def purge_eligible(spark, d):
    t = derived_corpus(spark, d)
    return B.purge_eligible(t["videos"], t["scenes"], embedded(t), t["transcript_segment"])


def transient(t: dict[str, DataFrame]) -> DataFrame:
    """A listing of transient files and web copies, with their sizes."""
    n = F.col("video_id").cast("int")
    rules = [("work/raw/", ".mp4", n % 3 == 0), ("web/", ".mp4", n % 6 < 4), ("work/candidates/", "/00001.jpg", n % 2 == 0), ("work/audio/", ".wav", n % 5 < 3)]
    paths = F.array(*[F.when(rule, F.struct(F.concat(F.lit(a), F.col("video_id"), F.lit(b)).alias("path"), (n * 1000 + k).cast("bigint").alias("bytes"))) for k, (a, b, rule) in enumerate(rules)])
    return t["videos"].select(F.explode(F.filter(paths, lambda p: p.isNotNull())).alias("f")).select("f.path", "f.bytes")


@query
def purge_files(spark, d):
    t = derived_corpus(spark, d)
    return B.purge_files(t | {"keyframes": embedded(t)}, transient(t))


@query
def video_cover(spark, d):
    t = derived_corpus(spark, d)
    return B.video_cover(t["videos"], t["scenes"], embedded(t))


@query
def scene_counts(spark, d):
    t = derived_corpus(spark, d)
    return B.scene_counts(t["videos"], t["scenes"].join(embedded(t).select("scene_id"), "scene_id", "left_semi"))


@query
def browse_videos(spark, d):
    t = derived_corpus(spark, d)
    return B.browse_videos(t["videos"], t["scenes"], t["keyframes"], 1, 10)


@query
def browse_scenes(spark, d):
    t = derived_corpus(spark, d)
    return B.browse_scenes(t["scenes"], t["keyframes"], "00002", 1)


@query
def filmstrips(spark, d):
    x = filmstrip(derived_corpus(spark, d)["keyframes"])
    return x.select("scene_id", F.array_join(F.transform("keyframes", lambda k: k["keyframe_id"].cast("string")), ",").alias("strip"))


@query
def selection_report(spark, d):
    t = derived_corpus(spark, d)
    return B.selection_report(t["scenes"], embedded(t), t["keyframe_caption"].where("length(caption) < 200").join(t["keyframes"], "keyframe_id").select("scene_id"))


@query
def keyframe_index(spark, d):
    return B.keyframe_index(derived_corpus(spark, d)["keyframes"]).select("keyframe_id", "index")


@query
def overlapping_segments(spark, d):
    x = derived_corpus(spark, d)["transcript_segment"].withColumn("shot_index", F.col("segment_id"))
    return B.overlap_warnings(x).select("segment_id")


@query
def knn_hamming(spark, d):
    t = derived_corpus(spark, d)
    return R.ann_candidates(t["query_vectors"], R.encode(t["keyframe_embedding"], "keyframe_id"), "keyframe_id", 1000).select("query_id", "keyframe_id", F.col("bits").cast("bigint").alias("bits"))


@query
def knn_codes(spark, d):
    """The 5 nearest sign codes by the stored index of their parts."""
    t = derived_corpus(spark, d)
    codes = R.encode(t["keyframe_embedding"], "keyframe_id")
    index = CodeIndex.build(spark, codes, "keyframe_id", words=2)
    return R.ann_candidates(t["query_vectors"], codes, "keyframe_id", 5, index).select("query_id", "keyframe_id", F.col("bits").cast("bigint").alias("bits"))


@query
def knn_rerank(spark, d):
    t = derived_corpus(spark, d)
    return R.knn(t["query_vectors"], t["keyframe_embedding"], "keyframe_id", 1000)


@query
def retrieve_visual(spark, d):
    t = derived_corpus(spark, d)
    gone = t["query_vectors"].select("query_id", F.lit("00002").alias("video_id"))
    return R.retrieve_visual(request(t), t, 50, exclude=gone)


@query
def retrieve_caption(spark, d):
    t = derived_corpus(spark, d)
    return R.retrieve_caption(request(t), t, 50)


@query
def retrieve_transcript(spark, d):
    t = derived_corpus(spark, d)
    return R.retrieve_transcript(request(t), t, 50)


@query
def retrieve_ocr(spark, d):
    t = searchable(spark, d)
    return R.retrieve_ocr(request(t), t, 50)


@query
def retrieve_ocr_indexed(spark, d):
    t = searchable(spark, d)
    return R.lexical_hits(request(t), t["keyframe_text"], "ocr_text", "keyframe_id", index=t["keyframe_text_index"])


@query
def phrase_in_transcripts(spark, d):
    t = searchable(spark, d, speech=True)
    q = phrased(t)
    return R.lexical_hits(q, t["transcript_segment"], "text", "segment_id", phrase=True, floor=0.0, index=t["transcript_segment_index"])


@query
def retrieve_asr_phrase(spark, d):
    t = searchable(spark, d, speech=True)
    q = phrased(t)
    return R.retrieve_asr_phrase(q, t, 50)


@query
def retrieve_ocr_phrase(spark, d):
    t = searchable(spark, d)
    q = phrased(t).withColumn("phrase", F.concat(F.get("tokens", F.lit(0)), F.lit(" the and in that this")))
    return R.retrieve_ocr_phrase(q, t, 50)


@query
def trigram_pairs(spark, d):
    t = derived_corpus(spark, d)["keyframe_text"]
    return t.select("keyframe_id", F.round(trigram_similarity(F.col("ocr_text"), F.lit("of the and in that this")), 6).alias("sim"))


@query
def similar_transcripts(spark, d):
    """What is said like each segment whose number is divisible by 20, itself included."""
    said = derived_corpus(spark, d)["transcript_segment"]
    q = said.where("segment_id % 20 = 0").select(F.col("segment_id").alias("query_id"), F.col("text").alias("phrase"))
    return R.similar_texts(q, said, "text", "segment_id", 0.45, "query_id")


@query
def similar_keyframes(spark, d):
    t = derived_corpus(spark, d)
    return R.similar_to_keyframe(t["query_vectors"].select(F.col("query_id").cast("bigint").alias("keyframe_id")), t, 10)


@query
def search_two_signal(spark, d):
    t = searchable(spark, d)
    return flat(search(request(t), t, ["visual", "ocr"], depth=200))


@query
def search_full(spark, d):
    t = searchable(spark, d)
    return flat(search(request(t), t, ["visual", "ocr", "caption", "transcript"], depth=200))


@query
def search_enriched(spark, d):
    t = searchable(spark, d)
    x = enrich(search(request(t), t, ["visual", "ocr"], depth=200), t)
    return x.select("query_id", "rank", "keyframe_id", "scene_id", "video_id", "shot_index", "start_ms", "ts_ms", "score", F.size("keyframes").alias("strip"))


@query
def search_page(spark, d):
    t = searchable(spark, d)
    return page(flat(search(request(t), t, ["visual", "ocr"], depth=200)), 2, 10).drop("scene_id")


@query
def signal_labels(spark, d):
    t = searchable(spark, d)
    x = merge_signal_labels(search(request(t), t, ["visual", "ocr", "caption", "transcript"], depth=200))
    return x.withColumn("share", F.round("share", 6))


def stage_hits(t: dict[str, DataFrame], n: int) -> DataFrame:
    """Hits of n stages: each stage of a query is a search with words of its own, all in one pass. Stored, as chains read them often."""
    number = lambda s: (F.col("query_id") * STAGES + s).cast("int")
    q = reduce(DataFrame.unionByName, [request(t, s).withColumn("query_id", number(s)) for s in range(n)])
    hits = link_rows(search(q, t, ["visual", "ocr"], depth=500, limit=300), t["keyframes"], 0)
    return stored(hits.withColumn("stage", F.col("query_id") % STAGES).withColumn("query_id", F.floor(F.col("query_id") / STAGES).cast("int")))


@query
def link_two_stages(spark, d):
    t = searchable(spark, d)
    x = link_chains(stage_hits(t, 2), [9000], per_video=3)
    return x.select("query_id", "video_id", "keyframe_id", F.round("reached", 6).alias("score"), F.get("path.keyframe_id", F.lit(1)).alias("second"), F.get("gaps_ms", F.lit(0)).alias("gap"))


@query
def link_three_stages(spark, d):
    t = searchable(spark, d)
    x = link_chains(stage_hits(t, 3), [9000, 12000], limit=200, per_video=3)
    return x.select("query_id", "video_id", "keyframe_id", "rank", F.round("reached", 6).alias("score"), F.array_join(F.transform("path", lambda p: p["keyframe_id"].cast("string")), ",").alias("path"))


@query
def farthest_points(spark, d):
    t = derived_corpus(spark, d)
    return B.farthest_point_select(t["keyframe_embedding"], t["keyframes"])


@query
def recall_at_20(spark, d):
    t = derived_corpus(spark, d)
    exact = stored(R.knn_exact(t["query_vectors"], t["keyframe_embedding"], "keyframe_id", 20))
    parts = [B.recall_at_k(R.knn(t["query_vectors"], t["keyframe_embedding"], "keyframe_id", n), exact, 20).withColumn("oversample", F.lit(n)) for n in (40, 1000)]
    return parts[0].unionByName(parts[1])


@query
def first_frame_share(spark, d):
    t = searchable(spark, d)
    return B.first_frame_share(search(request(t), t, ["visual", "ocr"], depth=200), t["keyframes"])


@query
def score_range(spark, d):
    t = searchable(spark, d)
    return B.score_range(R.best_texts(request(t), t, 20).withColumn("retriever", F.lit("ocr")), 20)


@query
def session_fold(spark, d):
    return S.session_records(derived_corpus(spark, d)["submissions"])


@query
def session_expiry(spark, d):
    return S.sessions_by_idle(derived_corpus(spark, d)["submissions"], 10)


@query
def session_snapshots(spark, d):
    return S.session_snapshot(S.session_records(derived_corpus(spark, d)["submissions"]))


@query
def hide_held(spark, d):
    t = searchable(spark, d)
    held = S.held_scenes(S.session_records(t["submissions"]))
    return S.hide_held(R.retrieve_ocr(request(t), t, 50), held, 3).drop("rank")


@query
def hide_held_sessions(spark, d):
    """Results of many sessions at once: each query asks for a session of its own."""
    t = searchable(spark, d)
    held = S.held_scenes(S.session_records(t["submissions"]))
    found = R.retrieve_ocr(request(t), t, 50).drop("rank").withColumn("code", (F.floor(F.col("query_id") / 20) % 50).cast("int"))
    return S.hide_held(found, held)


@query
def job_state(spark, d):
    return B.job_state(derived_corpus(spark, d)["job_events"])


@query
def job_status(spark, d):
    t = derived_corpus(spark, d)
    return B.job_state(t["job_events"]).join(t["videos"], "video_id").groupBy("collection", "stage").agg(F.count("*").alias("n"))


@query
def queued_scenes(spark, d):
    t = derived_corpus(spark, d)
    return B.restrict_to_queue(t["scenes"], B.job_state(t["job_events"])).select("scene_id")


@query
def event_hours(spark, d):
    return event_windows(C.read(spark, d, "events"))


@query
def user_sessions(spark, d):
    return session_windows(C.read(spark, d, "events"), "30 minutes")


@query
def query_history(spark, d):
    log = C.read(spark, d, "events").select("user_id", F.col("event_type").alias("query"), "ts")
    return B.query_history(log, 3).select("user_id", "query", "rank")


@query
def scalar_rules(spark, d):
    t = derived_corpus(spark, d)["transcript_segment"]
    ms = F.col("start_ms") + F.col("segment_id") % 977
    return t.select("segment_id", media.keyframe_count(ms).alias("keyframes"), media.format_timecode(ms * 90).alias("code"), media.parse_timecode(media.format_timecode(ms * 90)).alias("back"), media.format_duration(ms / 50).alias("length"), media.format_gap(ms).alias("gap"), media.scene_candidates(F.col("segment_id") % 50, ms / 40, F.lit(12), F.lit(90)).alias("candidates"), media.snap_ms_to_frame(ms, F.lit(25.0)).alias("frame"), media.candidate_stride(F.lit(25.0) + F.col("segment_id") % 7).alias("stride"), media.expected_candidates(ms, F.lit(12)).alias("expected"), media.is_degenerate(F.col("segment_id") % 300, F.lit(5.0), (F.col("segment_id") % 5) / 1000).alias("blank"), media.verdict_state(F.when(F.col("segment_id") % 3 == 0, "WRONG"), F.lit(200) + F.col("segment_id") % 4).alias("verdict"), F.round(cover_rank(F.col("segment_id") % 5), 6).alias("cover")).withColumns({"first": F.col("candidates.first"), "last": F.col("candidates.last")}).drop("candidates")


@query
def lexeme_counts(spark, d):
    x = derived_corpus(spark, d)["keyframe_text"].select(F.explode(lexemes(F.col("ocr_text"))).alias("token"))
    return x.groupBy("token").agg(F.count("*").alias("n"))


@query
def query_words(spark, d):
    x = derived_corpus(spark, d)["transcript_segment"]
    return x.select("segment_id", F.array_join(distinctive_tokens(F.col("text")), " ").alias("tokens"))


@query
def query_stages(spark, d):
    text = derived_corpus(spark, d)["transcript_segment"].select("segment_id", F.trim(F.regexp_replace("text", '[">]', "")).alias("w"))
    log = text.select(F.col("segment_id").alias("query_id"), F.concat(F.col("w"), F.lit(' text:"shop" >> (30) '), F.col("w"), F.lit(" -video:00003 >> said:hello there")).alias("raw"))
    phrases = [F.coalesce(c, F.lit("")).alias(c) for c in ("ocr_phrase", "asr_phrase")]
    return parse_log(log)[0].select("query_id", "stage", "free_text", *phrases, F.coalesce("gap_ms", F.lit(0)).alias("gap_ms"))


@query
def unit_vectors(spark, d):
    x = C.read(spark, d, "embeddings").select("vec_id", l2_normalize(F.transform("embedding", lambda v: v * 3)).alias("u"), "embedding")
    return x.select("vec_id", F.round(F.get("u", F.lit(0)), 6).alias("first"), F.round(cosine_distance(F.col("u"), F.reverse("embedding")), 6).alias("mirror"), hamming(binary_quantize(F.col("u")), binary_quantize(F.reverse("embedding"))).alias("bits"))


FOLDERS = ["work/raw", "data"]


def files(t: dict[str, DataFrame]) -> DataFrame:
    """A file listing: which videos have raw files, web copies and shot boundaries."""
    n = F.col("video_id").cast("int")
    rules = [("work/raw/", ".mp4", n % 3 == 0), ("work/raw/", ".mkv", n % 4 == 1), ("data/", ".webm", n % 5 < 3), ("data/", ".mp4", n % 7 == 2), ("web/", ".mp4", n % 6 < 4), ("shots/", ".scenes.txt", n % 2 == 0), ("shots/", ".tsv", n % 3 == 1), ("shots/9", ".csv", n % 11 == 0)]
    paths = F.array(*[F.when(rule, F.concat(F.lit(a), F.col("video_id"), F.lit(b))) for a, b, rule in rules])
    return t["videos"].select(F.explode(F.filter(paths, lambda p: p.isNotNull())).alias("path"))


def boundary_files(t: dict[str, DataFrame]) -> DataFrame:
    """The shots of each video as a text in one of three layouts."""
    n = F.col("video_id").cast("int") % 3
    start, end = F.col("start_ms"), F.col("end_ms")
    seconds = lambda c: F.format_string("%d.%03d", F.floor(c / 1000), c % 1000)
    named = F.concat_ws("\t", (start / 40).cast("int").cast("string"), seconds(start), (end / 40).cast("int").cast("string"), seconds(end))
    line = F.when(n == 0, named).when(n == 1, F.concat_ws(",", seconds(start), seconds(end))).otherwise(F.concat_ws(" ", media.format_timecode(start), media.format_timecode(end)))
    x = t["scenes"].groupBy("video_id").agg(F.sort_array(F.collect_list(F.struct("shot_index", line.alias("line")))).alias("l"))  # a video's shots are few
    head = F.when(n == 0, "# shots\nStart Frame\tstart\tEnd Frame\tend\n").otherwise("")
    return x.select("video_id", F.concat(head, F.array_join("l.line", "\n")).alias("text"))


def decode_log(t: dict[str, DataFrame]) -> DataFrame:
    n = F.col("event_id") % 120
    return t["job_events"].select("video_id", n.cast("bigint").alias("candidates"), media.decode_outcome(n, F.lit(80), F.col("stage") == "FAILED").alias("outcome"))


@query
def shot_boundaries(spark, d):
    t = derived_corpus(spark, d)
    return N.parse_shot_boundaries(boundary_files(t), t["videos"])[0]


@query
def source_files(spark, d):
    t = derived_corpus(spark, d)
    return N.source_file(t["videos"], files(t), FOLDERS)


@query
def paired_files(spark, d):
    return N.pair_files(files(derived_corpus(spark, d)), FOLDERS, "shots")


@query
def decode_worklist(spark, d):
    t = derived_corpus(spark, d)
    return N.decode_worklist(t["videos"], embedded(t), files(t), FOLDERS, "web")


@query
def select_worklist(spark, d):
    t = derived_corpus(spark, d)
    return N.select_worklist(t["videos"], t["scenes"], embedded(t))


@query
def stage_reports(spark, d):
    return N.stage_reports(derived_corpus(spark, d))


@query
def sliding_hours(spark, d):
    return event_windows(C.read(spark, d, "events"), "2 hours", "30 minutes", once=["event_id"])


@query
def live_sessions(spark, d):
    """Sessions that live at the end of the month."""
    e = C.read(spark, d, "events")
    kind = F.when(F.col("event_type") == "view", "list").when(F.col("event_type") == "click", "peek").otherwise("write")
    x = e.select(F.col("user_id").alias("code"), F.col("ts").cast("timestamp").alias("ts"), kind.alias("kind"))
    return S.live_sessions(x, F.lit("2024-01-31 00:00:00").cast("timestamp_ltz"), 180).select("code", "expires_in_ms")


@query
def live_snapshots(spark, d):
    return live_snapshot(derived_corpus(spark, d)["submissions"])


@query
def cascaded_rows(spark, d):
    """What is left of every table once the damaged videos are deleted."""
    t = derived_corpus(spark, d)
    left = C.cascade(t, "videos", t["videos"].where("damaged").select("video_id"))
    return B.content_counts(left, sorted({c for c, _, _, _ in C.PARENTS} & {*left}))


@query
def decode_report(spark, d):
    return N.decode_report(decode_log(derived_corpus(spark, d)))


@query
def caption_report(spark, d):
    t = derived_corpus(spark, d)
    return N.stage_report(t["keyframes"].where("kf_index = 0"), t["keyframe_caption"], ["keyframe_id"], "caption")


@query
def keyframe_fallbacks(spark, d):
    t = derived_corpus(spark, d)
    x = t["keyframes"].join(C.read(spark, d, "embeddings").select(F.col("vec_id").alias("keyframe_id"), "embedding"), "keyframe_id")
    x = x.select("scene_id", (F.col("ts_ms") / 40).cast("int").alias("frame"), F.abs(F.get("embedding", F.lit(0))).alias("luma_std"), ((F.col("scene_id") % 3 == 1) | (F.col("kf_index") == 0)).alias("degenerate"))
    frames = t["scenes"].withColumn("start_frame", (F.col("start_ms") / 40).cast("int")).withColumn("end_frame", (F.col("end_ms") / 40).cast("int"))
    return N.keyframe_fallbacks(frames, x)


@query
def recognised_text(spark, d):
    """Words of a text as recognised lines, the confidence by their length."""
    x = derived_corpus(spark, d)["keyframe_text"]
    lines = F.transform(F.split("ocr_text", " "), lambda w: F.struct(w.alias("text"), (F.length(w) / 10).alias("confidence")))
    return x.select("keyframe_id", N.ocr_lines(lines).alias("text"))


@query
def enqueue_manifest(spark, d):
    t = derived_corpus(spark, d)
    manifest = files(t).where("path like 'work/%' or path like 'data/%'").select(N.leading_id(F.col("path")).alias("video_id"), F.lit("V3C1").alias("collection"), F.col("path").alias("source_uri"))
    return N.enqueue(manifest, t["job_events"])


def sourced(t: dict[str, DataFrame]) -> DataFrame:
    """Queries with the sources and the collection that they ask for."""
    q = F.floor(F.col("query_id") / 20)  # query ids are multiples of 20
    named = F.when(q % 4 == 0, F.array(F.lit(" ASR "), F.lit("nowhere"))).when(q % 4 == 1, F.array(F.lit("ocr"), F.lit("visual"))).when(q % 4 == 2, F.array(F.lit("sound"))).otherwise(F.array().cast("array<string>"))
    return t["query_vectors"].select("query_id", named.alias("sources"), F.when(q % 3 == 0, "mvk").when(q % 3 == 1, "V3C2").alias("collection"))


@query
def permitted_retrievers(spark, d):
    return U.gate_sources(sourced(derived_corpus(spark, d)))


@query
def search_gated(spark, d):
    t = searchable(spark, d)
    q = request(t)
    ranked = R.retrieve_visual(q, t).withColumn("retriever", F.lit("visual")).unionByName(R.retrieve_ocr(q, t).withColumn("retriever", F.lit("ocr")))
    return flat(rrf_fuse(U.gate(ranked, U.gate_sources(sourced(t))), {"ocr": 4.0}, limit=48))


@query
def routed_models(spark, d):
    t = derived_corpus(spark, d)
    models = t["keyframe_embedding"].select("model_id").unionByName(t["caption_embedding"].select("model_id")).distinct().withColumn("name", F.concat(F.lit("m"), F.col("model_id").cast("string")))
    return U.route_model(sourced(t), models, "MVK:m10, v3c2:unknown,broken", "m1").select("query_id", "model_id")


@query
def models_with_rows(spark, d):
    t = derived_corpus(spark, d)
    models = C.read(spark, d, "region").select((F.col("r_regionkey") * 5).cast("int").alias("model_id"))
    return T.registered_models_with_rows(models, t["transcript_embedding"])


@query
def stage_summary(spark, d):
    """Stages and exclusions of a query log, with hits and chains of the stages of a linked search."""
    t = searchable(spark, d)
    log = t["query_vectors"].select("query_id", F.lit('the text:"open" >> (9) der said:"no way"').alias("raw"))
    hits = stage_hits(t, 2)
    return T.temporal_summary(parse_log(log)[0], hits, link_chains(hits, [9000], per_video=3))


@query
def used_signals(spark, d):
    t = searchable(spark, d)
    q = request(t)
    return T.signals_used(R.retrieve_visual(q, t, 50).withColumn("retriever", F.lit("visual")).unionByName(R.retrieve_ocr(q, t, 50).withColumn("retriever", F.lit("ocr"))).withColumn("stage", (F.floor(F.col("query_id") / 20) % 2).cast("int")))


@query
def video_details(spark, d):
    t = derived_corpus(spark, d)
    return T.video_details(t["videos"], t["keyframes"].join(t["query_vectors"].select(F.col("query_id").alias("keyframe_id")), "keyframe_id").select("video_id")).select("video_id", "collection", "seconds")


@query
def scene_details(spark, d):
    t = derived_corpus(spark, d)
    return T.scene_details(t["scenes"], t["keyframes"], t["query_vectors"].select(F.floor(F.col("query_id") / 4).alias("scene_id"))).select("scene_id", "shot_index", "keyframe_id")


@query
def session_list(spark, d):
    w = derived_corpus(spark, d)["submissions"]
    return T.session_list(w, F.lit(1706659200000).cast("bigint"))


@query
def chains_enriched(spark, d):
    t = searchable(spark, d)
    x = T.enrich_chains(link_chains(stage_hits(t, 2), [9000], limit=100, per_video=3), t)
    return x.select("query_id", "rank", F.round("score", 6).alias("score"), F.array_join(F.transform("scenes", lambda s: F.concat_ws("/", s["video_id"], s["shot_index"].cast("string"), s["keyframe_id"].cast("string"))), ",").alias("scenes"))


@query
def already_submitted(spark, d):
    t = searchable(spark, d)
    log = t["submissions"].where("status = 'CORRECT'").select("video_id", (F.col("scene_id") * 4 + F.col("event_id") % 4).alias("keyframe_id"))
    found = R.retrieve_ocr(request(t), t, 50).join(t["keyframes"].select("keyframe_id", "video_id"), "keyframe_id")
    return T.already_submitted(found, log).select("query_id", "keyframe_id", "submitted")


@query
def stability(spark, d):
    t = searchable(spark, d)
    run = lambda names: flat(search(request(t), t, names))  # noqa: E731  with another signal, to see what changes
    return T.stability_check(stored(run(["visual", "ocr"])), stored(run(["visual"])))


@query
def caption_vectors(spark, d):
    t = derived_corpus(spark, d)
    return embed_texts(t["keyframe_caption"].where("caption <> ''"), "caption", hash_encoder(), 10).select("keyframe_id", "model_id", F.size("embedding").alias("dims"))


@query
def loaded_vectors(spark, d):
    x = C.read(spark, d, "embeddings").select("vec_id", F.to_json("embedding").alias("literal"))
    v = parse_vector(F.col("literal"), 64)
    return x.select("vec_id", F.round(F.get(v, F.lit(63)), 6).alias("last"), F.size(v).alias("dims"))


@query
def submission_checks(spark, d):
    x = C.read(spark, d, "events").select((F.floor(F.col("event_id") / 3)).alias("answer_set"), (F.col("event_id") % 3).alias("answer"), F.when(F.col("event_type") != "view", F.col("event_type")).alias("media_item"), F.when(F.col("user_id") % 2 == 0, "V3C1").otherwise(" ").alias("collection"), F.when(F.col("user_id") % 3 == 0, "said").when(F.col("user_id") % 3 == 1, " ").alias("text"))
    return B.submission_check(x).select("answer_set", "valid", F.coalesce("reason", F.lit("")).alias("reason"))


def queries() -> dict[str, Query]:
    from shotweave.plans import whole

    return QUERIES | whole.QUERIES


def oracle_sql() -> dict[str, str]:
    from shotweave.plans import whole

    return ORACLES | whole.WHOLE_ORACLES
