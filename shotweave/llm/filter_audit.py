"""Filter interaction audit over failing-id relations.

Each filter has a stored table of the ids that fail it, with part and labels. What a filter removes after a prefix of others
is its table left-anti the tables of the prefix; what the prefix has taken from it already is redundant. All orders of a set
of filters leave the same survivors, so there are 80 (set, filter), not 600. They share five joins: a row that fails a filter
stands once for each set of others, and the table of each other filter is joined left-anti to the rows whose set has it.
Rows that fail nothing survive every prefix and enter no join. Ids are (text digest, doc_id), so no key is hot, and all joins
are on the id, so each table is shuffled once.
"""

from __future__ import annotations

from itertools import combinations, permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shotweave.sources.scratch import stored

SPACED = r"[^\x20\x09-\x0D]+"


def text_filters(text: Column, words: Column) -> dict[str, Column]:
    """Failure conditions: under 100 words, under 80 % distinct words, over 10 % capitals, markup signs."""
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {
        "A": F.size(words) < 100,
        "B": F.size(F.array_distinct(words)) * 100 < F.size(words) * 80,
        "C": capitals * 100 > F.length(text) * 10,
        "D": text.rlike(r"[#$%&*|]"),
    }


def measured(docs: DataFrame, doc_id: str, text: str, part: str) -> DataFrame:
    """(row, digest, id, part, fails): one narrow row per document; texts are read once."""
    base = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"))
    base = base.withColumns({"words": F.regexp_extract_all("text", F.lit(SPACED), F.lit(0)), "digest": F.unhex(F.sha2("text", 256))})
    checks = text_filters(F.col("text"), F.col("words"))
    fails = F.filter(F.array(*[F.when(c, F.lit(name)) for name, c in checks.items()]), lambda x: x.isNotNull())
    return base.select(_row(F.col("digest"), F.col("id")).alias("row"), "digest", "id", "part", fails.alias("fails"))


def _row(digest: Column, doc_id: Column) -> Column:
    return F.concat(digest, F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def later_copies(rows: DataFrame) -> DataFrame:
    """The rows whose text a smaller id has too: all rows with an id left-anti the first id of each text."""
    owned = rows.where("id is not null")
    first = owned.groupBy("digest").agg(F.min("id").alias("id")).select(_row(F.col("digest"), F.col("id")).alias("row"))
    return owned.join(first, "row", "left_anti")


def label_marks(labels: DataFrame) -> DataFrame:
    """(id, good, toxic) once per labelled id: whether any of its labels says so."""
    says = lambda c: F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0)))
    return labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(says("quality").alias("good"), says("toxic").alias("toxic"))


def failing_ids(rows: DataFrame, labels: DataFrame, duplicate: str = "E") -> DataFrame:
    """(row, part, good, toxic, n, filter): the stored id tables, a folder per filter; n counts rows that agree in id and text."""
    failed = rows.select("row", "id", "part", F.explode("fails").alias("filter"))
    failed = failed.unionByName(later_copies(rows).select("row", "id", "part", F.lit(duplicate).alias("filter")))
    # rows without an id have no label; the second key spreads them
    spread = F.when(F.col("id").isNull(), F.xxhash64("row")).otherwise(F.lit(0))
    marked = failed.withColumn("spread", spread).join(label_marks(labels).withColumn("spread", F.lit(0).cast("bigint")), ["id", "spread"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    marked = marked.select("row", "part", zero("good"), zero("toxic"), "filter")
    return stored(marked.groupBy("row", "part", "good", "toxic", "filter").agg(F.count("*").alias("n")), by="filter")


def removals(failing: DataFrame, names: list[str]) -> DataFrame:
    """(part, filter, before, removed, good, toxic): what each filter removes after each set of others, as a bit mask."""
    left = failing.select("row", "part", "filter", "n", "good", "toxic", F.lit(0).alias("before"))
    for i, s in enumerate(names):
        gone = failing.where(F.col("filter") == s).select(F.col("row").alias("failed"))
        either = F.when(F.col("filter") == s, F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))
        left = left.withColumn("stands", F.explode(either)).join(gone, (F.col("row") == F.col("failed")) & (F.col("stands") == 1), "left_anti")
        left = left.withColumn("before", F.col("before") + F.col("stands") * (1 << i)).drop("stands")
    return left.groupBy("part", "filter", "before").agg(F.sum("n").alias("removed"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


def mask(names: list[str], chosen) -> int:
    return sum(1 << names.index(x) for x in chosen)


def steps_of(spark: SparkSession, names: list[str]) -> DataFrame:
    """(filter_order, step, filter, before) of all orders: a table whose size depends on the number of filters alone."""
    rows = [("".join(order), i + 1, order[i], mask(names, order[:i])) for order in permutations(names) for i in range(len(order))]
    return spark.createDataFrame(rows, "filter_order string, step int, filter string, before int")


def audit_filters(spark: SparkSession, docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for each order of ABCDE.

    Counts are of document rows within the part, repeated rows each. Null texts count as empty, null parts as ''. A row without
    an id is nobody's later copy, and makes no other row one; it has no labels. An id with several labels is good, or toxic, if one of them
    says so. Null labels say nothing. Every part has all 600 rows, zeros included; no documents, no rows. Other columns are
    not read, whatever their names. `shapley` adds up what the filter removes in all orders.
    """
    names = ["A", "B", "C", "D", "E"]
    rows = stored(measured(docs, doc_id, text, part))
    counts = stored(removals(failing_ids(rows, labels), names))
    cells = [F.struct(F.lit(f).alias("filter"), F.lit(mask(names, s)).alias("before")) for f in names for size in range(len(names)) for s in combinations([x for x in names if x != f], size)]
    grid = rows.groupBy("part").agg(F.count("*").alias("docs")).select("part", "docs", F.inline(F.array(*cells)))
    grid = grid.join(counts, ["part", "filter", "before"], "left").fillna(0, ["removed", "good", "toxic"])
    alone = Window.partitionBy("part", "filter")
    last = (1 << len(names)) - 1
    of = lambda before: F.max(F.when(F.col("before") == before, F.col("removed"))).over(alone)
    own = F.create_map(*[x for i, f in enumerate(names) for x in (F.lit(f), F.lit(last - (1 << i)))])
    grid = grid.withColumns({"fails": of(0), "unique_fails": of(own[F.col("filter")])})
    steps = grid.join(F.broadcast(steps_of(spark, names)), ["filter", "before"])  # 600 rows
    so_far = Window.partitionBy("part", "filter_order").orderBy("step")
    return steps.select(
        "part", "filter_order", "step", (F.col("docs") - F.sum("removed").over(so_far)).alias("kept"), "removed", (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails",
        F.col("good").alias("good_lost"), F.col("toxic").alias("toxic_lost"), F.sum("removed").over(alone).alias("shapley"),
    )
