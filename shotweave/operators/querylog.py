"""Query-log jobs: raw search strings to stages, phrases, exclusions and gaps.

A string is cut once into stages and a stage once into pieces: phrases, exclusions and other words. What a stage searches
for is then read from its list of pieces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shotweave.functions.text import distinctive_tokens

MOST_STAGES = 4
#: A run of anything but an unquoted >>, or the separator itself; an open quote runs to the end. Plain text is taken in one
#: step: one for each character would overflow the stack on long strings.
TOKEN = r'(?:[^">]++|"[^"]*"|"[^"]*$|>(?!>))+|>>'
# The names of the operators.
OCR, ASR, VIDEO, VIDEOS = "text", "said", "-video:", "--exclude:"
NAME = "[A-Za-z0-9_]"
#: Where an operator begins.
BEGIN = rf"(?:(?<![\p{{L}}\p{{N}}_])(?i:{OCR}|{ASR}):|{VIDEO}{NAME}|{VIDEOS})"
START = rf"(?<![\p{{L}}\p{{N}}_])(?i:{OCR}|{ASR}):"
#: Phrases, operators whose phrase is cut by a lone quote and so is none, exclusions, and words.
PIECE = "|".join([rf'{START}(?:\s*"[^"]*"|(?:(?!\s+{BEGIN})[^"])*+(?!"|\s*"))', rf'{START}[^"]*"', rf"{VIDEO}{NAME}+", rf"{VIDEOS}\s*{NAME}*(?:\s*,\s*{NAME}+)*", rf"\S(?:(?!{BEGIN})\S)*+"])


def stages_of(log: DataFrame) -> DataFrame:
    """(query_id, at, window, s): the parts between separators in order, a leading window taken off in milliseconds."""
    tokens = F.regexp_extract_all(F.coalesce("raw", F.lit("")), F.lit(TOKEN), F.lit(0))
    parts = log.select("query_id", F.posexplode_outer(tokens).alias("at", "part"))
    before = F.lag("part").over(Window.partitionBy("query_id").orderBy("at"))
    parts = parts.withColumn("follows", F.coalesce(before == ">>", F.lit(False))).where("part is null or part <> '>>'")
    whole = F.regexp_extract("part", r"^\s*\([^()]*\)", 0)
    inner = F.lower(F.trim(F.regexp_replace(whole, r"[()]", " ")))
    ms = F.regexp_extract(inner, r"^d?\s*([0-9]+)\s*m?s?$", 1).try_cast("bigint") * F.when(F.endswith(inner, F.lit("ms")), 1).otherwise(1000)
    timed = F.col("follows") & ms.isNotNull()
    rest = F.substring("part", F.length(whole) + 1, F.length("part"))
    return parts.select("query_id", "at", F.when(timed, ms).alias("window"), F.when(timed, rest).otherwise(F.coalesce("part", F.lit(""))).alias("s"))


def _phrase(pieces: Column, name: str) -> Column:
    """The first phrase of an operator without its quotes; null where it is empty."""
    own = F.filter(pieces, lambda p: p.rlike(rf'^(?i:{name}):\s*("[^"]*"|[^"]*)$'))
    text = F.trim(F.translate(F.substring(F.get(own, F.lit(0)), len(name) + 2, 1 << 30), '"', ""))
    return F.when(text != "", text)


def parse_log(log: DataFrame, gap_ms: int = 60_000, most_gap_ms: int = 600_000, most: int = MOST_STAGES) -> tuple[DataFrame, DataFrame]:
    """(query_id, raw) to stages (query_id, stage, free_text, ocr_phrase, asr_phrase, tokens, gap_ms) and exclusions.

    Empty stages go with their window; one stage stays if all are empty; the first stage has no gap.
    """
    x = stages_of(log).withColumn("pieces", F.regexp_extract_all("s", F.lit(PIECE), F.lit(0)))
    is_phrase = lambda p: p.rlike(rf'^(?i:{OCR}|{ASR}):\s*("[^"]*"|[^"]*)$')
    is_video = lambda p: F.startswith(p, F.lit(VIDEO)) | F.startswith(p, F.lit(VIDEOS))
    words = F.filter("pieces", lambda p: ~is_phrase(p) & ~is_video(p))
    videos = F.transform(F.filter("pieces", is_video), lambda p: F.split(F.regexp_replace(p, "^[^:]*:", ""), ","))
    exclusions = x.select("query_id", F.explode(F.transform(F.flatten(videos), lambda v: F.trim(v))).alias("video_id")).where("video_id <> ''").distinct()
    x = x.select("query_id", "at", "window", F.array_join(words, " ").alias("free_text"), _phrase(F.col("pieces"), OCR).alias("ocr_phrase"), _phrase(F.col("pieces"), ASR).alias("asr_phrase"))
    full = (F.col("free_text") != "") | F.col("ocr_phrase").isNotNull() | F.col("asr_phrase").isNotNull()
    x = x.withColumn("full", full).withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("full").desc(), "at")))
    x = x.where("full or place = 1").where(F.col("place") <= most).withColumn("stage", F.col("place") - 1)
    gap = F.when(F.col("stage") > 0, F.least(F.coalesce("window", F.lit(gap_ms)), F.lit(most_gap_ms)))
    return x.select("query_id", "stage", "free_text", "ocr_phrase", "asr_phrase", distinctive_tokens(F.col("free_text")).alias("tokens"), gap.alias("gap_ms")), exclusions


def merged_exclusions(parsed: DataFrame, requested: DataFrame | None) -> DataFrame:
    """(query_id, video_id): what queries exclude in their text and what their request excludes, each once."""
    own = parsed.select("query_id", "video_id")
    return (own if requested is None else own.unionByName(requested.select("query_id", "video_id"))).distinct()
