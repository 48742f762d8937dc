"""The registered queries of this subpackage: each applies one operator with production parameters to a whole table."""

from __future__ import annotations

import re
from collections.abc import Callable
from secrets import token_hex

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shotweave.llm.centroids import cluster_vectors
from shotweave.llm.decontaminate import decontaminate
from shotweave.llm.embedding_dedup import near_vectors
from shotweave.llm.filter_audit import audit_filters
from shotweave.llm.jaccard_join import jaccard_components
from shotweave.llm.license_scan import scan_licenses
from shotweave.llm.mixing import mix
from shotweave.llm.pseudonyms import pseudonymize
from shotweave.llm.quality import fit_quality, score_quality
from shotweave.llm.sharding import shard_rows
from shotweave.llm.substring_dedup import remove_repeats
from shotweave.llm.token_counts import count_tokens
from shotweave.llm.toxicity import fit_toxicity, score_toxicity

#: Levels and target weights of the corpus mix; nodes that are not listed weigh 1.
LEVELS = ["domain", "lang", "source"]
WEIGHTS = {"domain": {"web": 5.0, "books": 3.0, "forum": 2.0}, "lang": {"en": 4.0, "de": 2.0}}
PART, EPOCHS, SEED = 0.5, 4, 13
WORD = r"[^\x20\x09-\x0D]+"
#: The setting that holds the secret of the pseudonyms.
KEY_SETTING = "spark.shotweave.pseudonyms.key"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def domain() -> Column:
    """Sources belong to three domains by their number."""
    n = F.regexp_extract(F.coalesce("source", F.lit("")), r"(\d+)", 1).try_cast("int") % 4
    return F.when(n < 2, "web").when(n == 2, "books").otherwise("forum")


def secret(spark: SparkSession) -> str:
    """The key that is set, else one that the session draws once: nobody knows it, and other sessions give other pseudonyms.

    The key is a literal of the plan, so plans and event logs are told to leave it out, unless the session has a rule of its own.
    """
    key = spark.conf.get(KEY_SETTING, None)
    if not key:
        key = token_hex(32)
        spark.conf.set(KEY_SETTING, key)
    if not spark.conf.get("spark.sql.redaction.string.regex", None):
        spark.conf.set("spark.sql.redaction.string.regex", re.escape(key))
    return key


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path())


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark, table(spark, sf_dir, "embeddings"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades: 0 low quality, 1 good but toxic, 2 good and clean; kept when P(grade >= 1), good quality, is at least 0.5."""
    documents = table(spark, sf_dir, "documents")
    ratings = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") * (2 - F.coalesce("toxic", F.lit(0)))).cast("int").alias("grade"))
    model = fit_quality(documents, ratings, "grade", 3)
    return score_quality(documents.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "expected_grade", "tail_probability", "kept")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(spark, table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark, table(spark, sf_dir, "documents"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymize(table(spark, sf_dir, "documents").select("doc_id", "text"), secret(spark), count="n_items")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents")).drop("detections")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").withColumn("domain", domain())
    return mix(documents, LEVELS, WEIGHTS, F.regexp_count("text", F.lit(WORD)), PART, EPOCHS, SEED)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = fit_toxicity(documents, table(spark, sf_dir, "labels"))
    scored = score_toxicity(documents.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(spark, table(spark, sf_dir, "documents"))


def op13_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(spark, table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_token_counts, op2_decontamination, op3_embedding_dedup, op4_quality, op5_substring_dedup, op6_jaccard_join, op7_pii, op8_license_scan, op9_mixing, op10_toxicity, op11_filter_audit, op12_sharding, op13_clustering]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    from shotweave.llm.oracles import ORACLES

    return dict(ORACLES)
