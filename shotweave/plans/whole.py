"""Searches of a query log as requests ask for them, and chains of searched sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotweave.functions.text import trigram_similarity
from shotweave.operators.encode import embed_queries, hash_encoder
from shotweave.operators.retrieve import knn_exact
from shotweave.operators.routing import enrich_chains
from shotweave.operators.search import prepared_stages, search_log, search_sequence
from shotweave.plans import registry
from shotweave.plans.fixtures import derived_corpus, searchable
from shotweave.plans.oracles import ALL, GRAMS, KINDS, LOG_CHAINS, LOG_RESULTS, LOG_STAGES, VIEWS, near
from shotweave.plans.registry import Query

QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


@query
def whole_knn(spark, d):
    t = derived_corpus(spark, d)
    return knn_exact(t["query_vectors"], t["keyframe_embedding"], "keyframe_id", 200)


@query
def whole_trigram_pairs(spark, d):
    """The whole text of each keyframe against that of the next one."""
    x = derived_corpus(spark, d)["keyframe_text"]
    after = x.select((F.col("keyframe_id") - 1).alias("keyframe_id"), F.col("ocr_text").alias("after"))
    return x.join(after, "keyframe_id").select("keyframe_id", F.round(trigram_similarity(F.col("ocr_text"), F.col("after")), 6).alias("sim"))


def embed(stages: DataFrame) -> DataFrame:
    """The vectors of a stage's text, for the routed model and for that of the text tables."""
    text = embed_queries(stages.select("query_id", "stage", "free_text"), "free_text", hash_encoder(), 10).select("query_id", "stage", F.col("embedding").alias("text_embedding"))
    return embed_queries(stages.drop("model_id"), "free_text", hash_encoder(), 1).join(text, ["query_id", "stage"])


def log_of(t: dict[str, DataFrame]) -> DataFrame:
    """A log of requests: one to three stages with words of their own, phrases, exclusions, sources and collections."""
    q = F.col("query_id")
    words = F.array(*[F.lit(" ".join(w)) for w in registry.WORDS])
    first, second = F.get(words, q % 3), F.get(words, (q + 1) % 3)
    then = F.concat(F.lit(" >> (9) "), second, F.when(q % 2 == 0, F.lit(' >> (12) said:"of the"')).otherwise(""))
    raw = F.concat(first, F.when(q % 7 == 0, F.lit(' text:"of the"')).otherwise(""), F.when(q % 9 == 0, F.lit(" -video:00003")).otherwise(""), F.when(q % 40 == 0, then).otherwise(""))
    exclude = F.when(q % 60 == 0, F.array(F.lit("00001"), F.lit("00003"))).otherwise(F.array().cast("array<string>"))
    return registry.sourced(t).select("query_id", raw.alias("raw"), "sources", "collection", exclude.alias("exclude"))


def searched(spark, d):
    t = searchable(spark, d, speech=True)
    models = spark.read.parquet(f"{d}/region.parquet").where("r_regionkey = 1").select(F.col("r_regionkey").cast("int").alias("model_id"), F.lit("base").alias("name"))
    return t, (log_of(t), t, embed, models, "MVK:base", "base")


@query
def log_stages(spark, d):
    """What the requests of a log search for, with the merged exclusions of each."""
    _, (log, _, add, *models) = searched(spark, d)
    stages, filters = prepared_stages(log, add, *models)
    gone = filters["exclude"].groupBy("query_id").agg(F.array_join(F.array_sort(F.collect_set("video_id")), ",").alias("excluded"))
    text = [F.coalesce(c, F.lit("")).alias(c) for c in ("ocr_phrase", "asr_phrase", "excluded")]
    return stages.join(gone, "query_id", "left").select("query_id", "stage", "free_text", F.coalesce("gap_ms", F.lit(0)).alias("gap_ms"), "model_id", *text)


@query
def log_results(spark, d):
    """Fused results of the requests with one stage, each gated and filtered as it asks."""
    _, args = searched(spark, d)
    return search_log(*args)[0].select("query_id", "rank", "keyframe_id", "scene_id", "video_id", F.round("score", 6).alias("score"))


@query
def log_chains(spark, d):
    """Chains of the requests with several stages."""
    _, args = searched(spark, d)
    return search_log(*args)[1].select("query_id", "rank", "video_id", F.round("reached", 6).alias("score"), F.array_join(F.transform("path", lambda p: p["keyframe_id"].cast("string")), ",").alias("path"))


def sequences(t: dict[str, DataFrame]) -> DataFrame:
    """Stages of a log in which every query has two or three stages with texts of their own."""
    from shotweave.functions.text import lexemes
    from shotweave.operators.querylog import parse_log

    q = F.col("query_id")
    words = F.array(*[F.lit(w[0]) for w in registry.WORDS])
    third = F.when(q % 40 == 0, F.lit(' >> (12) said:"of the"')).otherwise("")
    log = t["query_vectors"].select("query_id", F.concat(F.get(words, q % 3), F.lit(' text:"of the" >> (9) '), F.get(words, (q + 1) % 3), third).alias("raw"))
    return embed(parse_log(log)[0]).withColumn("tokens", lexemes(F.col("free_text")))


@query
def whole_link_sequences(spark, d):
    t = searchable(spark, d, speech=True)
    x = search_sequence(sequences(t), t, chains=200)
    return x.select("query_id", "video_id", "keyframe_id", "rank", F.round("reached", 6).alias("score"), F.array_join(F.transform("path", lambda p: p["keyframe_id"].cast("string")), ",").alias("path"))


@query
def whole_chains_enriched(spark, d):
    t = searchable(spark, d, speech=True)
    x = enrich_chains(search_sequence(sequences(t), t, chains=100), t)
    return x.select("query_id", "rank", F.round("score", 6).alias("score"), F.array_join(F.transform("scenes", lambda s: F.concat_ws("/", s["video_id"], s["shot_index"].cast("string"), s["keyframe_id"].cast("string"))), ",").alias("scenes"))


WHOLE_ORACLES = {
    "log_stages": VIEWS + LOG_STAGES,
    "log_results": VIEWS + LOG_RESULTS,
    "log_chains": VIEWS + LOG_CHAINS,
    "whole_link_sequences": VIEWS + KINDS + "select query_id, video_id, keyframe_id, rank, round(reached, 6) score, path from placed where rank <= 200",
    "whole_chains_enriched": VIEWS + KINDS + """, steps as (select query_id, rank, reached, unnest(string_split(path, ',')) kf, generate_subscripts(string_split(path, ','), 1) i from placed where rank <= 100)
select query_id, rank, round(any_value(reached), 6) score, string_agg(video_id || '/' || scene_id % 5 || '/' || keyframe_id, ',' order by i) scenes from steps join keyframes on keyframe_id = kf::bigint group by query_id, rank""",
    "whole_knn": VIEWS + near("", "keyframe_embedding", "keyframe_id", ALL) + "select * from knn where rank <= 200",
    "whole_trigram_pairs": VIEWS + f""", g as (select keyframe_id, {GRAMS('ocr_text')} g from keyframe_text)
select a.keyframe_id, round(coalesce(len(list_intersect(a.g, b.g)) / nullif(len(list_distinct(list_concat(a.g, b.g))), 0), 0), 6) sim from g a join g b on b.keyframe_id = a.keyframe_id + 1""",
}
