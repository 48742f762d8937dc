"""Fused search, enrichment and ordered chains."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shotweave.functions.text import lexemes
from shotweave.operators import retrieve as R
from shotweave.operators.querylog import MOST_STAGES, merged_exclusions, parse_log
from shotweave.operators.ranking import rank_list, rrf_fuse, top_k
from shotweave.operators.rules import gate_sources, route_model
from shotweave.operators.shared import once_by, once_by_rows
from shotweave.sources.scratch import stored

# Default fusion weights.
WEIGHTS = {"visual": 1.0, "ocr": 4.0, "transcript": 1.0, "caption": 1.0, "ocr_phrase": 8.0, "asr_phrase": 8.0}
RETRIEVERS = {"visual": R.retrieve_visual, "ocr": R.retrieve_ocr, "caption": R.retrieve_caption, "transcript": R.retrieve_transcript, "ocr_phrase": R.retrieve_ocr_phrase, "asr_phrase": R.retrieve_asr_phrase}


@dataclass(frozen=True)
class SearchConfig:
    """Depths and cuts of a search; a chained one goes deeper."""

    depth: int = 200
    segments: int = 500
    limit: int = 48
    chain_depth: int = 500
    chain_limit: int = 1000
    per_video: int = 3
    gap_ms: int = 60_000
    most_gap_ms: int = 600_000


def search(queries: DataFrame, t: dict[str, DataFrame], retrievers: list[str], limit: int = 48, depth: int = 200, weights: dict[str, float] | None = None, **filters) -> DataFrame:
    """Fused results of several retrievers for a table of queries (query_id, model_id, embedding, tokens, phrase)."""
    parts = [RETRIEVERS[name](queries, t, depth, **filters).withColumn("retriever", F.lit(name)) for name in retrievers]
    ranked = parts[0]
    for p in parts[1:]:
        ranked = ranked.unionByName(p)
    return rrf_fuse(ranked, WEIGHTS | (weights or {}), limit=limit)


def filmstrip(keyframes: DataFrame) -> DataFrame:
    """(scene_id, keyframes): the keyframes of a scene in time order; a scene has few."""
    return keyframes.groupBy("scene_id").agg(F.sort_array(F.collect_list(F.struct("ts_ms", "keyframe_id", "kf_index"))).alias("keyframes"))


def enrich(fused: DataFrame, t: dict[str, DataFrame]) -> DataFrame:
    """Adds video, shot and filmstrip; rows whose keyframe is gone drop out; the score is rounded for output.

    Filmstrips are built for the shots of the results only.
    """
    found = fused.drop("scene_id").join(t["keyframes"], "keyframe_id")
    strips = filmstrip(t["keyframes"].join(found.select("scene_id").distinct(), "scene_id", "left_semi"))
    x = found.join(t["scenes"].drop("video_id"), "scene_id").join(t["videos"], "video_id").join(strips, "scene_id")
    return x.withColumn("score", F.round("score", 6))


def best_successors(hits: DataFrame, then: DataFrame, gap: int | Column) -> DataFrame:
    """`hits` with the best row of `then` (query_id, video_id, scene_id, keyframe_id, ts_ms, reached, path) as a struct `next`.

    A successor lies in the same video and another scene, later by less than the gap; the best has the highest rounded score,
    then the earliest time, then the smallest keyframe. Time is cut into bins as long as the gap: a successor is in the hit's
    bin after it, or in the next one before the hit's time plus the gap, so both are running maxima in the order of time. To
    leave the hit's own scene out, the best two of different scenes run along: whatever the running best displaces or outdoes is a loser,
    and the best loser of another scene than the winner's is the second.
    """
    keys = ["query_id", "video_id"]
    if not isinstance(gap, int):
        then = then.join(hits.groupBy("query_id").agg(F.max(gap).alias("gap")), "query_id")
    reach = F.lit(gap) if isinstance(gap, int) else F.col("gap")
    value = F.struct(F.round("reached", 9).alias("r"), (-F.col("ts_ms")).alias("t"), (-F.col("keyframe_id")).alias("k"), "scene_id", "reached", "path")
    bin_of = lambda x, g: F.floor(x / g).cast("bigint")
    both = lambda one, two: F.explode(F.array(one, two))
    at = lambda side, bin_, order: F.struct(F.lit(side).alias("side"), bin_.alias("bin"), order.cast("bigint").alias("at"))
    t = F.col("ts_ms")
    values = then.select(*keys, both(at(0, bin_of(t, reach), -t), at(1, bin_of(t, reach), t)).alias("e"), value.alias("value"), F.col("scene_id").alias("own"), F.lit(None).cast("bigint").alias("hit"))
    own_gap = F.lit(gap) if isinstance(gap, int) else gap
    probes = hits.select(*keys, both(at(0, bin_of(t, own_gap), -t), at(1, bin_of(t, own_gap) + 1, t + own_gap)).alias("e"), F.lit(None).cast(values.schema["value"].dataType).alias("value"), F.col("scene_id").alias("own"), F.col("keyframe_id").alias("hit"))
    rows = values.unionByName(probes).where("e.bin is not null")  # a stage without a gap has no successors
    # a hit stands before values at its place, as bounds are strict
    order = Window.partitionBy(*keys, "e.side", "e.bin").orderBy("e.at", F.col("hit").isNull(), "value")
    before, so_far = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("best", F.max("value").over(before))
    loser = F.when(F.col("best.scene_id") != F.col("value.scene_id"), F.least("best", "value"))
    rows = rows.withColumn("second", F.max(loser).over(so_far)).where("hit is not null")
    found = F.when(F.col("best.scene_id") != F.col("own"), F.col("best")).otherwise(F.col("second"))
    chosen = rows.groupBy(*keys, F.col("hit").alias("keyframe_id")).agg(F.max(found).alias("next")).where("next is not null")
    return hits.join(chosen, [*keys, "keyframe_id"])


def link_chains(hits: DataFrame, gaps: list[int | Column], limit: int | None = None, per_video: int = 3) -> DataFrame:
    """The best chain from each first-stage hit through all later stages, inside one video.

    hits: query_id, stage, video_id, scene_id, keyframe_id, ts_ms, score; a stage has a keyframe once. A successor lies in another
    scene, after the hit and less than the stage's gap away; of several the one with the best reachable score, then the
    earliest, then the best placed. Stages are linked from the last one back; videos that lack a stage are dropped first.
    """
    stages = len(gaps) + 1
    every = hits.groupBy("query_id", "video_id").agg(F.count_distinct("stage").alias("n")).where(F.col("n") == stages)
    # steps are stored: all have the same keys, so they would be one stage, whose tasks hold the sorts of all steps at once
    hits = stored(hits.join(every, ["query_id", "video_id"], "left_semi"))
    step = F.array(F.struct("scene_id", "keyframe_id", "ts_ms"))
    best = hits.where(F.col("stage") == stages - 1).select("query_id", "video_id", "scene_id", "keyframe_id", "ts_ms", F.col("score").alias("reached"), step.alias("path"))
    for stage in range(stages - 2, -1, -1):
        pick = best_successors(hits.where(F.col("stage") == stage), best, gaps[stage])
        best = stored(pick.select("query_id", "video_id", "scene_id", "keyframe_id", "ts_ms", (F.col("score") + F.col("next.reached")).alias("reached"), F.concat(step, "next.path").alias("path")))
    own = rank_list(best, ["query_id", "video_id"], F.round("reached", 9).desc(), F.col("scene_id"), F.col("keyframe_id")).where(F.col("rank") <= per_video).drop("rank")
    out = rank_list(own, ["query_id"], F.round("reached", 9).desc(), F.col("scene_id"), F.col("video_id"), F.col("keyframe_id"))
    out = out.withColumn("gaps_ms", F.transform(F.sequence(F.lit(1), F.lit(stages - 1)), lambda i: F.get(F.col("path.ts_ms"), i) - F.get(F.col("path.ts_ms"), i - 1)))
    return out.where(F.col("rank") <= limit) if limit else out


#: A stage of a query is a query of its own: query_id * STAGES + stage. A query log holds fewer stages.
STAGES = 16


def stage_results(stages: DataFrame, t: dict[str, DataFrame], depth: int = 500, limit: int = 1000, weights: dict[str, float] | None = None, exclude: DataFrame | None = None, permitted: DataFrame | None = None, wanted: DataFrame | None = None, **filters) -> DataFrame:
    """Hits (query_id, stage, video_id, scene_id, keyframe_id, ts_ms, score) of a full search per stage.

    stages: as parse_log gives them, with the vectors `embedding` (model_id) and `text_embedding`, null where a stage has none.
    Free text asks the visual, ocr, caption and transcript retrievers, a phrase its own one; `permitted` (query_id, retriever)
    holds what a query may ask, `wanted` (query_id, collection) where, `exclude` (query_id, video_id) what it does not want.
    """
    q = stages.withColumn("owner", F.col("query_id")).withColumn("query_id", F.col("query_id").cast("bigint") * STAGES + F.col("stage"))
    per_stage = lambda df, c: q.select("owner", "query_id").join(df.select(F.col("query_id").alias("owner"), c), "owner").drop("owner")
    if exclude is not None:
        filters["exclude"] = per_stage(exclude, "video_id")
    if wanted is not None:
        filters["wanted"] = per_stage(wanted, "collection")
    free = q.where("free_text <> ''")
    text = free.withColumn("embedding", F.col("text_embedding"))
    ocr = q.where("ocr_phrase is not null").withColumn("tokens", lexemes(F.col("ocr_phrase"))).withColumn("phrase", F.col("ocr_phrase"))
    asr = q.where("asr_phrase is not null").withColumn("tokens", lexemes(F.col("asr_phrase")))
    asked = {"visual": free.where("embedding is not null"), "ocr": free, "caption": text, "transcript": text, "ocr_phrase": ocr, "asr_phrase": asr}
    if permitted is not None:
        asked = {name: x.join(permitted.where(F.col("retriever") == name).select(F.col("query_id").alias("owner")), "owner", "left_semi") for name, x in asked.items()}
    ranked = reduce(DataFrame.unionByName, [RETRIEVERS[name](x, t, depth, **filters).withColumn("retriever", F.lit(name)) for name, x in asked.items()])
    hits = link_rows(rrf_fuse(ranked, WEIGHTS | (weights or {}), limit=limit), t["keyframes"], 0)
    return hits.withColumn("stage", (F.col("query_id") % STAGES).cast("int")).withColumn("query_id", F.floor(F.col("query_id") / STAGES).cast(stages.schema["query_id"].dataType))


def prepared_stages(log: DataFrame, embed: Callable[[DataFrame], DataFrame], models: DataFrame, routes: str, default: str, config: SearchConfig = SearchConfig()) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Stages of a query log with their vectors, and the filters of `stage_results` that its requests ask for.

    log: query_id, raw, sources (array<string>), collection, and optionally exclude (array<string>). `embed` adds the columns
    `embedding` and `text_embedding` to stages with a model_id; the model is that of the request's collection.
    """
    stages, parsed = parse_log(log.select("query_id", "raw"), config.gap_ms, config.most_gap_ms)
    requested = log.select("query_id", F.explode("exclude").alias("video_id")) if "exclude" in log.columns else None
    model = route_model(log.select("query_id", "collection"), models, routes, default).select("query_id", "model_id")
    ready = stored(embed(stages.join(model, "query_id").withColumn("tokens", lexemes(F.col("free_text")))))
    return ready, {"exclude": stored(merged_exclusions(parsed, requested)), "permitted": stored(gate_sources(log)), "wanted": log.select("query_id", "collection")}


def search_log(log: DataFrame, t: dict[str, DataFrame], embed: Callable[[DataFrame], DataFrame], models: DataFrame, routes: str, default: str, config: SearchConfig = SearchConfig()) -> tuple[DataFrame, DataFrame]:
    """(results, chains) of a query log as requests ask for them: parse, gate, route, retrieve, fuse, link.

    Queries of one stage give fused results (query_id, rank, keyframe_id, scene_id, video_id, ts_ms, score); queries of
    several stages give chains. Both can be enriched. A log repeats itself: requests that are equal in all but their id are
    searched once, so the search grows with the different requests, and only its results with all of them.
    """
    requests = once_by(log, [c for c in ("raw", "sources", "collection", "exclude") if c in log.columns])
    stages, filters = prepared_stages(requests.first, embed, models, routes, default, config)
    count = stages.groupBy("query_id").agg(F.count("*").alias("n"))
    single, several = (stages.join(count.where(c).select("query_id"), "query_id", "left_semi") for c in ("n = 1", "n > 1"))
    hits = stage_results(single, t, config.depth, config.limit, **filters)
    results = rank_list(hits.drop("stage"), ["query_id"], F.round("score", 9).desc(), F.col("keyframe_id"))
    chains = search_sequence(several, t, config.limit, config.per_video, depth=config.chain_depth, limit=config.chain_limit, **filters)
    return requests.given(results, config.limit), requests.given(chains, config.limit)


def link_stages(hits: DataFrame, stages: DataFrame, limit: int | None = None, per_video: int = 3) -> DataFrame:
    """Chains through all stages of each query, with the query's own gaps; queries of one stage have no chain."""
    gap = stages.select("query_id", (F.col("stage") - 1).alias("stage"), F.col("gap_ms").alias("reach"))
    count = stages.groupBy("query_id").agg(F.count("*").alias("stages"))
    x = hits.join(gap, ["query_id", "stage"], "left").join(count, "query_id")
    asked = {r["stages"] for r in count.where(F.col("stages").between(2, MOST_STAGES)).select("stages").distinct().collect()} or {2}  # few numbers
    parts = [link_chains(x.where(F.col("stages") == n).drop("stages"), [F.col("reach")] * (n - 1), limit, per_video) for n in sorted(asked)]
    return reduce(DataFrame.unionByName, parts)


def search_sequence(stages: DataFrame, t: dict[str, DataFrame], chains: int | None = None, per_video: int = 3, **kwargs) -> DataFrame:
    """Ordered chains of queries that have a search for each stage, 500 deep and 1000 fused; the anchor's score is the chain's.

    Stages and hits are used often, so they are stored once in the shared scratch folder. Without filters of their own, queries
    whose stages are all equal are searched and linked once.
    """
    stages = stored(stages)
    if any(kwargs.get(x) is not None for x in ("exclude", "permitted", "wanted")):
        return link_stages(stored(stage_results(stages, t, **kwargs)), stages, chains, per_video)
    asked = once_by_rows(stages, "stage")
    return asked.given(link_stages(stored(stage_results(asked.first, t, **kwargs)), asked.first, chains, per_video), chains)


def link_rows(fused: DataFrame, keyframes: DataFrame, stage: int) -> DataFrame:
    """The hits of one stage, with video and time and the unrounded score."""
    return fused.join(keyframes.select("keyframe_id", "video_id", "ts_ms"), "keyframe_id").select("query_id", F.lit(stage).alias("stage"), "video_id", "scene_id", "keyframe_id", "ts_ms", "score")
