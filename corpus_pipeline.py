"""Five stages from raw documents to a training mix; each one's result is stored as Parquet and is the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shotweave.llm.decontaminate import decontaminate
from shotweave.llm.graph import stored
from shotweave.llm.jaccard_join import keep_one, row_key
from shotweave.llm.mixing import mix
from shotweave.llm.pseudonyms import pseudonymize
from shotweave.llm.queries import EPOCHS, LEVELS, PART, SEED, WEIGHTS, WORD, domain, secret, table
from shotweave.llm.toxicity import fit_toxicity, score_toxicity


def fresh(name: str, docs: DataFrame) -> str:
    """A column name that `docs` does not have."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return name


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents with a toxicity of 0.3 or more; rows, repeated ones too, and columns else stay as they are.

    The model is fitted on the labelled rows of the whole table. Null and empty texts have the base rate, which is below the
    limit unless most labelled rows are toxic. Without a single toxic label, or without labels, nothing is rejected.
    """
    model = fit_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    score = fresh("score", docs)
    return score_toxicity(docs, model, out=score).where(F.col(score) < 0.3).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group that links of 0.8 or more on five-word shingles connect.

    Rows are told apart by id and text, so rows that share an id but not a text are judged each on its own; rows that agree in
    both are one. Null texts and such without words link with nothing and stay. Other columns may have any name.
    """
    return keep_one(spark, docs, size=5, percent=80)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that hold a ten-word window of a benchmark item; items of fewer words are one window.

    Rows are judged by id and text, so rows that share an id, or have none, are told apart. Null texts, empty ones and an
    empty benchmark reject nothing; repeated rows share their fate.
    """
    key = fresh("row_key", docs)
    own = docs.withColumn(key, row_key(F.col("doc_id"), F.col("text")))
    hit = decontaminate(spark, own, table(spark, sf_dir, "benchmark"), doc_id=key).where("n_hit > 0").select(F.col("doc_id").alias(key)).distinct()
    return own.join(hit, key, "left_anti").select(*docs.columns)


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal items by format-preserving pseudonyms; no row is dropped, and only `text` changes.

    `n_chars` and all other columns stay, as lengths do not change. Null and empty texts stay.
    """
    return pseudonymize(docs, secret(spark))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What each domain, language and source gives to the mix, by document and epoch.

    A column of `docs` named `domain` is not read: the domain follows from the source. Texts without words are never taken, null
    languages and sources form nodes of their own, repeated rows are taken each. An empty table gives an empty mix.
    """
    return mix(docs.withColumn("domain", domain()), LEVELS, WEIGHTS, F.regexp_count("text", F.lit(WORD)), PART, EPOCHS, SEED)


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("benchmark", benchmark), ("pseudonyms", pseudonyms), ("mixture", mixture)]
#: The first two stages learn weights and connect components, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs = held = stored(stage(spark, docs, sf_dir), instead=held)  # a stage's input goes once its result is complete
    return STAGES[-1][1](spark, docs, sf_dir)
