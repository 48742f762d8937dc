"""Ingest and enrichment jobs: file pairing, shot boundaries, work lists, keyframe fallbacks, stage reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shotweave.functions.media import frame_to_ms, timecode_to_ms
from shotweave.operators.browse import pending
from shotweave.operators.ranking import rank_list

# Kinds of boundary fields, header names of frame columns, sampled rows and the share that decides a column.
INTEGER, TIMECODE, DECIMAL = r"^\d+$", r"^\d{1,2}:\d{2}(:\d{2})?([.,]\d{1,6})?$", r"^\d+[.,]\d+$"
FRAME_START = ["startframe", "start_frame", "framestart", "frame_start"]
FRAME_END = ["endframe", "end_frame", "frameend", "frame_end"]
SAMPLE, SHARE = 200, 0.6
# File kinds in order of preference, and the least confidence of a recognised line.
VIDEO_KINDS = ["mp4", "mkv", "webm", "avi", "mov"]
BOUNDARY_KINDS = ["txt", "tsv", "csv"]
CONFIDENCE = 0.5


def leading_id(path: Column) -> Column:
    """The file name up to its first dot."""
    return F.regexp_extract(path, r"([^/.]*)[^/]*$", 1)


def source_file(videos: DataFrame, files: DataFrame, folders: list[str], kinds: list[str] = VIDEO_KINDS) -> DataFrame:
    """(video_id, path): the file of each video by order of folder, then of extension, then path; null where there is none.

    files: path, as a file listing gives it. The best path of an id is one aggregate with map-side combine.
    """
    folder, kind = F.regexp_extract("path", r"^(.*)/[^/]*$", 1), F.regexp_extract("path", r"\.([^./]+)$", 1)
    place = lambda c, names: F.array_position(F.array(*map(F.lit, names)), c)
    x = files.select("path", leading_id(F.col("path")).alias("video_id"), place(folder, folders).alias("f"), place(kind, kinds).alias("k")).where("f > 0 and k > 0")
    best = x.groupBy("video_id").agg(F.min_by("path", F.struct("f", "k", "path")).alias("path"))
    return videos.select("video_id").join(best, "video_id", "left")


def pair_files(files: DataFrame, folders: list[str], boundary_folder: str) -> DataFrame:
    """(video_id, video, boundary, state): videos and boundary files with one leading id; state paired, no_boundary or no_video."""
    every = files.select(leading_id(F.col("path")).alias("video_id")).distinct()
    video = source_file(every, files, folders).withColumnRenamed("path", "video")
    boundary = source_file(every, files, [boundary_folder], BOUNDARY_KINDS).withColumnRenamed("path", "boundary")
    state = F.when(F.col("boundary").isNull(), "no_boundary").when(F.col("video").isNull(), "no_video").otherwise("paired")
    return video.join(boundary, "video_id").where("video is not null or boundary is not null").withColumn("state", state)


def read_boundary_files(spark: SparkSession, path: str) -> DataFrame:
    """(video_id, text) of the boundary files below a path; each holds the shots of one video."""
    return spark.read.text(path, wholetext=True).select(leading_id(F.col("_metadata.file_path")).alias("video_id"), F.col("value").alias("text"))


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that later expressions name often; the generator keeps the optimizer from copying them into each place."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def _kind(field: Column) -> Column:
    return F.when(field.rlike(INTEGER), "int").when(field.rlike(TIMECODE), "timecode").when(field.rlike(DECIMAL), "float").otherwise("other")


def _fields(line: Column) -> Column:
    """The fields of a line: by tab, else comma, else blanks."""
    clean = lambda sep: F.filter(F.transform(F.split(line, sep), lambda f: F.trim(f)), lambda f: f != "")
    return F.when(F.contains(line, F.lit("\t")), clean("\t")).when(F.contains(line, F.lit(",")), clean(",")).otherwise(clean(r"\s+"))


def _columns(x: DataFrame) -> DataFrame:
    """Adds `at`, (start, end, kind) of a file (header, rows): named frame columns, or else the first two columns of one kind."""
    names = F.transform("header", lambda h: F.replace(F.lower(h), F.lit(" "), F.lit("")))
    named = lambda keys: F.array_position(F.transform("names", lambda n: n.isin(keys)), True).cast("int") - 1
    x = _once(x, names=names, sample=F.transform(F.slice("rows", 1, SAMPLE), lambda r: F.transform(r, lambda f: _kind(f))))
    x = _once(x, start=named(FRAME_START), end=named(FRAME_END))
    width = F.array_min(F.transform("sample", lambda r: F.size(r)))
    share = lambda c, kinds: F.size(F.filter("sample", lambda r: F.get(r, c).isin(kinds))) / F.size("sample") >= SHARE
    kind = lambda c: F.when(share(c, ["int"]), "int").when(share(c, ["timecode"]), "timecode").when(share(c, ["int", "float"]), "float").otherwise("other")
    x = _once(x, kinds=F.transform(F.sequence(F.lit(0), width - 1), lambda c: F.struct(c.alias("c"), kind(c).alias("k"))))
    at = F.when((F.col("start") >= 0) & (F.col("end") >= 0), F.struct("start", "end", F.lit("frame").alias("kind")))
    of_kind = lambda k: F.filter("kinds", lambda e: e["k"] == k)
    for k, name in (("int", "frame"), ("timecode", "timecode"), ("float", "seconds")):
        x = x.withColumn(k, of_kind(k))
        at = at.when(F.size(k) >= 2, F.struct(F.get(k, F.lit(0))["c"].alias("start"), F.get(k, F.lit(1))["c"].alias("end"), F.lit(name).alias("kind")))
    return _once(x, at=F.when(F.size("rows") > 0, at))


def parse_shot_boundaries(files: DataFrame, videos: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Boundary files (video_id, text) and videos (video_id, fps, duration_ms) to (shots, warnings).

    shots: video_id, shot_index, start_frame, end_frame, start_ms, end_ms; warnings: video_id, line (null for a whole file),
    problem. A line splits on tab, else comma, else blanks; lines of one field and comments drop. A first row with a field that
    is no number is a header. Rows that are too short, unreadable or end before they start are skipped with a warning; an overlap
    with the accepted shot before, and shots past the last frame, only warn. Null and empty texts give the warning `no lines`.
    """
    lines = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), r"\r\n|\r|\n"), lambda s: F.trim(s)), lambda s: (s != "") & ~F.startswith(s, F.lit("#")))
    x = _once(files.select("video_id", "text"), all=F.filter(F.transform(lines, lambda s: _fields(s)), lambda r: F.size(r) >= 2))
    first = F.coalesce(F.get("all", F.lit(0)), F.array().cast("array<string>"))
    x = x.withColumn("headed", F.exists(first, lambda f: _kind(f) == "other"))
    x = x.withColumn("header", F.when(F.col("headed"), first).otherwise(F.array().cast("array<string>")))
    x = _once(x, rows=F.when(F.col("headed"), F.slice("all", F.lit(2), F.size("all"))).otherwise(F.col("all")))
    x = _columns(x).select("video_id", "all", "rows", "at").join(videos.select("video_id", "fps", "duration_ms"), "video_id")
    whole = x.withColumn("problem", F.when(F.size("all") == 0, "no lines").when(F.size("rows") == 0, "only a header").when(F.col("at").isNull(), "no start and end columns")).where("problem is not null")
    row = x.where("at is not null").select("video_id", "fps", "duration_ms", "at.*", F.posexplode("rows").alias("line", "row"))
    row = row.withColumn("line", F.col("line") + 1).withColumn("a", F.get("row", "start")).withColumn("b", F.get("row", "end"))
    kind = F.col("kind")
    decimal = lambda c: F.bround(F.replace(c, F.lit(","), F.lit(".")).try_cast("double") * 1000, 0).try_cast("bigint")
    ms = lambda c: F.when(kind == "frame", frame_to_ms(c.try_cast("bigint"), F.col("fps"))).when(kind == "timecode", timecode_to_ms(c)).otherwise(decimal(c))
    frame = lambda c, t: F.when(kind == "frame", c.try_cast("bigint")).otherwise(F.bround(F.col(t) / 1000 * F.col("fps"), 0).cast("bigint"))
    row = _once(row, start_ms=ms(F.col("a")), end_ms=ms(F.col("b")))
    row = _once(row, start_frame=frame(F.col("a"), "start_ms"), end_frame=frame(F.col("b"), "end_ms"))
    bad = F.when(F.col("b").isNull() | F.col("a").isNull(), "too few fields").when(F.col("start_frame").isNull() | F.col("end_frame").isNull(), "unreadable").when(F.col("end_frame") < F.col("start_frame"), "end before start")
    row = row.withColumn("problem", bad)
    w = Window.partitionBy("video_id").orderBy("line")
    good = row.where("problem is null").withColumn("shot_index", F.row_number().over(w) - 1).withColumn("before", F.lag("end_frame").over(w))
    past = good.where(F.col("start_frame") > F.bround(F.col("duration_ms") / 1000 * F.col("fps"), 0)).groupBy("video_id").agg(F.count("*").alias("n"))
    none = row.groupBy("video_id").agg(F.count_if(F.col("problem").isNull()).alias("n")).where("n = 0")
    warned = row.where("problem is not null").select("video_id", "line", "problem")
    warned = warned.unionByName(good.where("start_frame < before").select("video_id", "line", F.lit("overlaps the shot before").alias("problem")))
    for df, text in ((whole, F.col("problem")), (past, F.lit("shots past the end")), (none, F.lit("no valid shots"))):
        warned = warned.unionByName(df.select("video_id", F.lit(None).cast("int").alias("line"), text.alias("problem")))
    return good.select("video_id", "shot_index", "start_frame", "end_frame", "start_ms", "end_ms"), warned


def ocr_lines(lines: Column, least: float = CONFIDENCE) -> Column:
    """The text of recognised lines, array<struct<text,confidence>>: confident ones (bound included), trimmed, not blank, joined."""
    kept = F.transform(F.filter(lines, lambda x: x["confidence"] >= least), lambda x: F.trim(x["text"]))
    return F.coalesce(F.array_join(F.filter(kept, lambda t: t != ""), " "), F.lit(""))


def decode_report(log: DataFrame) -> DataFrame:
    """Totals of a decode log (outcome, candidates)."""
    n = lambda *kinds: F.count_if(F.col("outcome").isin(*kinds))
    return log.agg(F.count("*").alias("videos"), n("ok", "damaged").alias("decoded"), n("damaged").alias("damaged"), n("failed").alias("failed"), F.coalesce(F.sum("candidates"), F.lit(0)).alias("candidates"))


def stage_report(entities: DataFrame, done: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(status, n): of all entities of a stage, how many have text, are done without (silent), or are still to do (pending)."""
    x = entities.select(keys).join(done.select(*keys, F.col(text).alias("__text"), F.lit(True).alias("__done")), keys, "left")
    status = F.when(F.col("__done").isNull(), "pending").when(F.coalesce(F.trim("__text"), F.lit("")) == "", "silent").otherwise("with_text")
    return x.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


def stage_reports(t: dict[str, DataFrame], frames: DataFrame | None = None) -> DataFrame:
    """(stage, status, n) of recognition, captions, speech and vectors: with text, silent, pending, and skipped without sound."""
    kf, videos = t["keyframes"], t["videos"]
    spoken = t["transcript_segment"].groupBy("video_id").agg(F.concat_ws(" ", F.max("text")).alias("text"))
    made = lambda name: t[name].select("keyframe_id", F.lit("vector").alias("made")).distinct()
    parts = {
        "text": stage_report(frames or kf, t["keyframe_text"], ["keyframe_id"], "ocr_text"),
        "captions": stage_report((frames or kf).where("kf_index = 0"), t["keyframe_caption"], ["keyframe_id"], "caption"),
        "transcripts": stage_report(videos.where("has_audio"), spoken, ["video_id"], "text").unionByName(videos.where("not has_audio").agg(F.count("*").alias("n")).select(F.lit("skipped").alias("status"), "n").where("n > 0")),
        "vectors": stage_report(kf, made("keyframe_embedding"), ["keyframe_id"], "made"),
        "caption_vectors": stage_report(t["keyframe_caption"], made("caption_embedding"), ["keyframe_id"], "made"),
    }
    named = [df.select(F.lit(stage).alias("stage"), "status", "n") for stage, df in parts.items()]
    return reduce(DataFrame.unionByName, named)


def decode_worklist(videos: DataFrame, keyframes: DataFrame, files: DataFrame, folders: list[str], web_folder: str) -> DataFrame:
    """(video_id, path, state): videos without keyframes or without a web copy; state ready, or missing where no source exists."""
    finished = keyframes.select("video_id").join(source_file(videos, files, [web_folder]).where("path is not null"), "video_id", "left_semi")
    x = source_file(pending(videos, finished, ["video_id"]), files, folders)
    return x.withColumn("state", F.when(F.col("path").isNull(), "missing").otherwise("ready"))


def select_worklist(videos: DataFrame, scenes: DataFrame, keyframes: DataFrame, force: bool = False) -> DataFrame:
    """Videos with scenes and no keyframes; with `force` all that have scenes."""
    x = videos.select("video_id").join(scenes.select("video_id"), "video_id", "left_semi")
    return x if force else pending(x, keyframes, ["video_id"])


def keyframe_fallbacks(scenes: DataFrame, candidates: DataFrame) -> DataFrame:
    """(scene_id, rule, frame): what shots without a usable candidate show.

    candidates: scene_id, frame, luma_std, degenerate. A shot without candidates shows its middle frame; one with degenerate
    candidates only shows the one of the largest deviation, the earliest of equals. Other shots give no row.
    """
    best = candidates.groupBy("scene_id").agg(F.bool_and("degenerate").alias("blank"), F.max_by("frame", F.struct(F.coalesce("luma_std", F.lit(-1.0)), -F.col("frame"))).alias("best"))
    x = scenes.select("scene_id", "start_frame", "end_frame").join(best, "scene_id", "left").where("blank is null or blank")
    rule = F.when(F.col("blank").isNull(), "middle").otherwise("textured")
    return x.select("scene_id", rule.alias("rule"), F.coalesce("best", F.floor((F.col("start_frame") + F.col("end_frame")) / 2)).cast("bigint").alias("frame"))


def enqueue(manifest: DataFrame, jobs: DataFrame) -> DataFrame:
    """New jobs (video_id, collection, source_uri) of a manifest: the least source of each id that has no job yet."""
    first = rank_list(manifest, ["video_id"], F.col("source_uri")).where("rank = 1").drop("rank")
    return pending(first, jobs, ["video_id"])
