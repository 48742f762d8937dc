"""The corpus tables: a reader, the writers that keep them up to date, and their rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The tables of a corpus and their columns. Vectors are tables of their own, keyed by model.
SCHEMAS = {
    "videos": "video_id string, collection string, fps double, duration_ms int, width int, height int, has_audio boolean, damaged boolean",
    "scenes": "scene_id bigint, video_id string, shot_index int, start_frame int, end_frame int, start_ms int, end_ms int",
    "keyframes": "keyframe_id bigint, scene_id bigint, video_id string, kf_index int, frame_number int, ts_ms int",
    "keyframe_text": "keyframe_id bigint, ocr_text string",
    "keyframe_caption": "keyframe_id bigint, caption string, model string",
    "transcript_segment": "segment_id bigint, video_id string, start_ms int, end_ms int, text string, lang string",
    "ingest_jobs": "video_id string, collection string, source_uri string, stage string, attempts int, last_error string, host string, claimed_at timestamp, updated_at timestamp",
    "embedding_models": "model_id int, name string, dims int",
    "keyframe_embedding": "keyframe_id bigint, model_id int, embedding array<float>",
    "caption_embedding": "keyframe_id bigint, model_id int, embedding array<float>",
    "transcript_embedding": "segment_id bigint, model_id int, embedding array<float>",
}
# The stages of an ingest job.
STAGES = ["PENDING", "FETCHED", "DECODED", "SELECTED", "EMBEDDED", "OCR_DONE", "CAPTIONED", "ASR_DONE", "LOADED", "PURGED", "FAILED"]
#: Child table, its key, the parent's key and the parent.
PARENTS = [
    ("scenes", "scene_id", "video_id", "videos"),
    ("keyframes", "keyframe_id", "scene_id", "scenes"),
    ("keyframes", "keyframe_id", "video_id", "videos"),
    ("keyframe_text", "keyframe_id", "keyframe_id", "keyframes"),
    ("keyframe_caption", "keyframe_id", "keyframe_id", "keyframes"),
    ("keyframe_embedding", "keyframe_id", "keyframe_id", "keyframes"),
    ("caption_embedding", "keyframe_id", "keyframe_id", "keyframe_caption"),
    ("transcript_segment", "segment_id", "video_id", "videos"),
    ("transcript_embedding", "segment_id", "segment_id", "transcript_segment"),
]


def read_corpus(spark: SparkSession, path: str, kind: str = "parquet") -> dict[str, DataFrame]:
    """The tables of `path`/<table> with their declared columns; nothing is inferred, absent columns are null.

    A table that is not there is an error, as an empty one could pass for a corpus without that signal.
    """
    return {name: spark.read.schema(columns).format(kind).load(f"{path.rstrip('/')}/{name}") for name, columns in SCHEMAS.items()}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def latest(df: DataFrame, keys: list[str], recency: list[str]) -> DataFrame:
    """One row per key: the last by `recency`, then by all other columns, so the choice never depends on the run."""
    rest = [c for c in df.columns if c not in keys]
    row = F.max_by(F.struct(*rest), F.struct(*recency, *[F.col(c).cast("string") for c in rest]))
    return df.groupBy(*keys).agg(row.alias("_row")).select(*keys, "_row.*").select(df.columns) if rest else df.distinct()


def append_new(target: DataFrame, incoming: DataFrame, keys: list[str], recency: list[str] | None = None) -> DataFrame:
    """The rows of `incoming` to append: one of each key that the target has not, the last by `recency`."""
    new = incoming.join(target.select(keys), keys, "left_anti")
    return latest(new, keys, recency or []).select(target.columns)


def upsert(target: DataFrame, incoming: DataFrame, keys: list[str], recency: list[str] | None = None) -> DataFrame:
    """The target after insert-or-overwrite by key; of several incoming rows of a key the last by `recency` wins."""
    kept = target.join(incoming.select(keys).distinct(), keys, "left_anti").select(target.columns)
    return kept.unionByName(latest(incoming, keys, recency or []).select(target.columns))


def replace_for(target: DataFrame, incoming: DataFrame, keys: list[str], gone: DataFrame | None = None) -> DataFrame:
    """The target after all rows of the keys in `gone` are deleted and the incoming rows are loaded.

    `gone` lists the keys that are replaced, also such as have no new row; without it they are those of `incoming`.
    """
    which = (incoming if gone is None else gone).select(keys).distinct()
    return target.join(which, keys, "left_anti").select(target.columns).unionByName(incoming.select(target.columns))


def cascade(t: dict[str, DataFrame], parent: str, gone: DataFrame) -> dict[str, DataFrame]:
    """All tables after the rows of `parent` whose key is in `gone` are deleted, with everything that depends on them."""
    key = gone.columns[0]
    out = dict(t) | {parent: t[parent].join(gone.select(key), key, "left_anti")}
    for child, _, link, above in PARENTS:  # parents come first in the list
        if child in out and above in out and out[above] is not t.get(above):
            out[child] = out[child].join(out[above].select(link), link, "left_semi").select(t[child].columns)
    return out


def violations(t: dict[str, DataFrame]) -> DataFrame:
    """(rule, table, key, detail): every broken not-null, check, unique and foreign-key rule of the tables that are given.

    Rules on columns that a table does not carry are left out.
    """
    found: list[DataFrame] = []

    def bad(rule: str, table: str, key: str, df: DataFrame, detail: Column) -> None:
        found.append(df.select(F.lit(rule).alias("rule"), F.lit(table).alias("table"), F.col(key).cast("string").alias("key"), detail.cast("string").alias("detail")))

    def check(rule: str, table: str, key: str, broken: str, *columns: str) -> None:
        if table in t and {*columns} <= {*t[table].columns}:
            bad(rule, table, key, t[table].where(broken), F.concat_ws(" ", *[F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("null"))) for c in columns]))

    def unique(table: str, key: str, *columns: str) -> None:
        if table in t and {*columns} <= {*t[table].columns}:
            twice = t[table].groupBy(*columns).agg(F.count("*").alias("n"), F.min(F.col(key)).alias("_key")).where("n > 1")
            bad(f"unique {', '.join(columns)}", table, "_key", twice, F.concat(F.lit("rows="), F.col("n").cast("string")))

    required = {"videos": ("video_id", ["video_id", "collection", "fps", "duration_ms", "has_audio"]), "scenes": ("scene_id", ["scene_id", "video_id", "shot_index", "start_frame", "end_frame", "start_ms", "end_ms"]), "keyframes": ("keyframe_id", ["keyframe_id", "scene_id", "video_id", "kf_index", "frame_number", "ts_ms"]), "keyframe_text": ("keyframe_id", ["keyframe_id", "ocr_text"]), "keyframe_caption": ("keyframe_id", ["keyframe_id", "caption", "model"]), "transcript_segment": ("segment_id", ["segment_id", "video_id", "start_ms", "end_ms", "text"]), "ingest_jobs": ("video_id", ["video_id", "collection", "source_uri", "stage", "attempts", "updated_at"])}
    for table, (key, columns) in required.items():
        for c in columns:
            check(f"{c} is null", table, key, f"{c} is null", c)
        unique(table, key, key)
    check("fps", "videos", "video_id", "fps <= 0", "fps")
    check("duration", "videos", "video_id", "duration_ms < 0", "duration_ms")
    for table, key, columns in (("scenes", "scene_id", ["shot_index", "start_frame", "start_ms"]), ("keyframes", "keyframe_id", ["kf_index", "frame_number", "ts_ms"]), ("transcript_segment", "segment_id", ["start_ms"]), ("ingest_jobs", "video_id", ["attempts"])):
        for c in columns:
            check(f"{c} below 0", table, key, f"{c} < 0", c)
    check("frame order", "scenes", "scene_id", "end_frame < start_frame", "start_frame", "end_frame")
    check("time order", "scenes", "scene_id", "end_ms < start_ms", "start_ms", "end_ms")
    check("time order", "transcript_segment", "segment_id", "end_ms < start_ms", "start_ms", "end_ms")
    check("stage", "ingest_jobs", "video_id", f"stage not in ({', '.join(map(repr, STAGES))})", "stage")
    unique("scenes", "scene_id", "video_id", "shot_index")
    unique("scenes", "scene_id", "video_id", "start_frame", "end_frame")
    unique("keyframes", "keyframe_id", "scene_id", "kf_index")
    for child, key, link, above in PARENTS:
        if child in t and above in t:
            bad(f"no {above}", child, key, t[child].where(F.col(link).isNotNull()).join(t[above].select(link), link, "left_anti"), F.concat(F.lit(f"{link}="), F.col(link).cast("string")))
    if {"transcript_segment", "videos"} <= {*t}:
        late = t["transcript_segment"].join(t["videos"].select("video_id", "duration_ms"), "video_id").where("end_ms > duration_ms")
        bad("past the end", "transcript_segment", "segment_id", late, F.concat_ws(" ", F.concat(F.lit("end_ms="), F.col("end_ms").cast("string")), F.concat(F.lit("duration_ms="), F.col("duration_ms").cast("string"))))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def read_manifest(spark: SparkSession, path: str, collection: str) -> DataFrame:
    """(video_id, collection, source_uri): 'id<TAB>uri' or a bare uri, whose id is its file name up to the first dot."""
    line = spark.read.text(path).select(F.trim("value").alias("l")).where("l <> '' and not startswith(l, '#')")
    uri = F.when(F.instr("l", "\t") > 0, F.trim(F.regexp_extract("l", "\t(.*)$", 1))).otherwise(F.col("l"))
    named = F.when(F.instr("l", "\t") > 0, F.trim(F.regexp_extract("l", "^([^\t]*)\t", 1))).otherwise(F.regexp_extract("l", r"([^/.]*)[^/]*$", 1))
    return line.select(named.alias("video_id"), F.lit(collection).alias("collection"), uri.alias("source_uri"))


def normalize_probe(probes: DataFrame) -> DataFrame:
    """(video_id, fps, duration_ms, frames, width, height, has_audio, ok) from (video_id, json) of a media probe.

    The number of frames is that of the stream, or duration times rate. `probe_errors` tells why a row is not ok.
    """
    schema = "streams array<struct<codec_type:string,avg_frame_rate:string,r_frame_rate:string,duration:string,nb_frames:string,width:int,height:int>>, format struct<duration:string>"
    p = probes.select("video_id", F.from_json("json", schema).alias("j"))
    p = p.withColumn("v", F.get(F.filter("j.streams", lambda s: s["codec_type"] == "video"), F.lit(0)))

    def rate(c: str):
        a = F.split(F.col(c), "/")
        r = F.try_divide(F.get(a, F.lit(0)).try_cast("double"), F.coalesce(F.get(a, F.lit(1)).try_cast("double"), F.lit(1.0)))
        return F.when(r > 0, r)

    p = p.withColumn("fps", F.coalesce(rate("v.avg_frame_rate"), rate("v.r_frame_rate"))).withColumn("s", F.coalesce(F.col("v.duration").try_cast("double"), F.col("j.format.duration").try_cast("double")))
    ok = F.col("v").isNotNull() & F.col("fps").isNotNull() & F.col("s").isNotNull()
    return p.select("video_id", "fps", F.bround(F.col("s") * 1000, 0).cast("int").alias("duration_ms"), F.coalesce(F.col("v.nb_frames").try_cast("bigint"), F.bround(F.col("s") * F.col("fps"), 0).cast("bigint")).alias("frames"), "v.width", "v.height", F.coalesce(F.exists("j.streams", lambda s: s["codec_type"] == "audio"), F.lit(False)).alias("has_audio"), ok.alias("ok"))


def probe_errors(probes: DataFrame) -> DataFrame:
    """(video_id, problem) of the probes that give no usable video."""
    x = normalize_probe(probes).where("not ok")
    problem = F.when(F.col("fps").isNull() & F.col("duration_ms").isNull(), "no video stream").when(F.col("fps").isNull(), "no frame rate").otherwise("no duration")
    return x.select("video_id", problem.alias("problem"))
