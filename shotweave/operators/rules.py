"""Request rules: which retrievers a query may ask, and which model serves its collection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# What a request's sources permit; phrase retrievers are never gated.
SOURCES = {"visual": "visual", "ocr": "ocr", "asr": "transcript", "caption": "caption"}
GATED = list(SOURCES.values())
PHRASES = ["ocr_phrase", "asr_phrase"]


def gate_sources(queries: DataFrame) -> DataFrame:
    """(query_id, retriever) that each query (query_id, sources: array<string>) may run.

    No sources permit all; unknown names only narrow; blanks and case do not count; phrase retrievers always stay.
    """
    known = F.create_map(*[F.lit(x) for kv in SOURCES.items() for x in kv])
    named = F.transform("sources", lambda s: F.element_at(known, F.lower(F.trim(s))))
    every = F.array(*map(F.lit, GATED))
    allowed = F.when(F.coalesce(F.size("sources"), F.lit(0)) <= 0, every).otherwise(F.array_intersect(every, F.filter(named, lambda s: s.isNotNull())))
    return queries.select("query_id", F.explode(F.concat(allowed, F.array(*map(F.lit, PHRASES)))).alias("retriever"))


def gate(ranked: DataFrame, permitted: DataFrame) -> DataFrame:
    """Ranked rows whose retriever the query may run."""
    return ranked.join(permitted, ["query_id", "retriever"], "left_semi")


def route_model(queries: DataFrame, models: DataFrame, routes: str, default: str) -> DataFrame:
    """Adds `model_id` to queries (collection): that of the collection's route 'A:model,B:model', if registered, else the default's.

    models: model_id, name; the registry is a small table by nature, one row per trained encoder. Entries without a colon do not count.
    """
    known = {c.strip().upper(): m.strip() for c, _, m in (e.strip().partition(":") for e in routes.split(",") if ":" in e)}
    name = F.lit(None).cast("string")
    for collection, model in known.items():
        name = F.when(F.upper(F.trim("collection")) == collection, model).otherwise(name)
    own = models.groupBy("name").agg(F.min("model_id").alias("__id"))
    x = queries.withColumn("__name", name).join(own.withColumnRenamed("name", "__name"), "__name", "left").drop("__name")
    base = own.where(F.col("name") == default).agg(F.min("__id").alias("__base"))
    return x.crossJoin(F.broadcast(base)).withColumn("model_id", F.coalesce("__id", "__base")).drop("__id", "__base")  # one row
