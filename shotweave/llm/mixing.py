"""Mixing sources to target weights by hierarchical budgeting, in DataFrame operations only.

A tree of levels (say domain, language, source) splits a token budget by weights from the root down. A node can give no
more than its capacity, the tokens below it times the allowed epochs. What a node lacks goes to its siblings in proportion
to their weights; only what all of them together cannot give is missing at the parent, where the parent's siblings make up
for it. A leaf then takes whole seeded epochs and a token-prefix of the next one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shotweave.llm.graph import stored


def share(df: DataFrame, parent: list[str], budget: str, out: str) -> DataFrame:
    """Splits the parent's `budget` over its children by water-filling: min(capacity, level * weight), summing up to it.

    In order of capacity / weight, a child is full when the budget covers all before it and the same level for the rest.
    Children without weight must have no capacity.
    """
    whole = Window.partitionBy(*parent)
    before = whole.orderBy("__ratio", "__name").rowsBetween(Window.unboundedPreceding, -1)
    so_far = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0.0))
    x = df.withColumn("__ratio", F.when(F.col("weight") > 0, F.col("capacity") / F.col("weight")).otherwise(F.lit(0.0)))
    x = x.withColumn("__full", F.col(budget) >= so_far("capacity") + F.col("__ratio") * (F.sum("weight").over(whole) - so_far("weight")))
    x = x.withColumn("__left", F.col(budget) - F.sum(F.when(F.col("__full"), F.col("capacity")).otherwise(0.0)).over(whole))
    x = x.withColumn("__open", F.sum(F.when(F.col("__full"), 0.0).otherwise(F.col("weight"))).over(whole))
    part = F.when(F.col("__full"), F.col("capacity")).otherwise(F.greatest(F.lit(0.0), F.col("__left") * F.col("weight") / F.col("__open")))
    return x.withColumn(out, part).drop("__ratio", "__full", "__left", "__open")


def weight_of(weights: dict[str, float], name: Column) -> Column:
    """The weight of a node by its name; nodes that are not listed have weight 1."""
    out = F.lit(1.0)
    for key, value in weights.items():
        out = F.when(name == key, float(value)).otherwise(out)
    return out


def leaf_budgets(leaves: DataFrame, levels: list[str], weights: dict[str, dict[str, float]], part_of_all: float, epochs: int) -> DataFrame:
    """`leaves` (the levels, docs, tokens) with `budget` in whole tokens.

    The budget at the root is `part_of_all` times all tokens, or the whole capacity if that is less. Weightless nodes give
    nothing. The table has one row per leaf, so it is as small as the tree.
    """
    x = leaves
    for level in levels:
        x = x.withColumn(f"__w_{level}", weight_of(weights.get(level, {}), F.col(level)))
    alive = F.lit(True)
    for level in levels:
        alive = alive & (F.col(f"__w_{level}") > 0)
    x = x.withColumn("__cap", F.when(alive, F.col("tokens") * F.lit(float(epochs))).otherwise(0.0)).withColumn("__root", F.lit(0))
    every = Window.partitionBy("__root")
    x = x.withColumn("__budget", F.least(F.sum("tokens").over(every) * F.lit(part_of_all), F.sum("__cap").over(every)))
    for depth, level in enumerate(levels):
        parent, path = ["__root", *levels[:depth]], ["__root", *levels[: depth + 1]]
        own = x.groupBy(*path).agg(F.sum("__cap").alias("capacity"), F.first("__budget").alias("given"), F.first(f"__w_{level}").alias("weight"))
        own = own.withColumn("weight", F.when(F.col("capacity") > 0, F.col("weight")).otherwise(0.0)).withColumn("__name", F.col(level))
        own = share(own, parent, "given", "__new").select(*path, "__new")
        x = x.join(own, path).drop("__budget").withColumnRenamed("__new", "__budget")
    return x.select(*leaves.columns, F.floor(F.col("__budget") + 1e-6).cast("bigint").alias("budget"))


def place(seed: int, epoch: Column, doc_id: Column) -> Column:
    """The seeded place of a document in an epoch: 32 hexadecimal digits, ordered as text."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def mix(df: DataFrame, levels: list[str], weights: dict[str, dict[str, float]], tokens: Column, part_of_all: float = 0.5, epochs: int = 4, seed: int = 13, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, the levels, epoch, n_tokens, take_tokens): what each leaf gives in each epoch.

    Within an epoch a leaf's documents stand in the order of md5(seed:epoch:doc_id); the last epoch stops where the leaf's
    budget is met, with the last document cut to take_tokens. Null level values form the node ''. Texts without tokens, null
    ones included, are never taken; a row without an id is placed by the digest of its text. Rows that share an id share their
    place and are taken in the order of their tokens, each row once; which of rows with equal tokens comes first does not show. Long texts count
    whole. An empty table gives an empty result. Columns that are not levels are not read, whatever their names; levels may
    not be called name, key, range, rest, whole or ranges.

    No leaf is ordered in one task: it is cut into about sqrt(documents) ranges of the order, whose sums tell which ranges
    are taken; only the one range that the budget cuts is ordered, per leaf.
    """
    name = F.coalesce(F.col(doc_id).cast("string"), F.md5(F.col(text).cast("string"))) if text in df.columns else F.col(doc_id).cast("string")
    rows = df.select(F.col(doc_id).alias("doc_id"), name.alias("name"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in levels], tokens.cast("bigint").alias("n_tokens"))
    rows = stored(rows.where("n_tokens > 0"))
    leaves = rows.groupBy(*levels).agg(F.count("*").alias("docs"), F.sum("n_tokens").alias("tokens"))
    plan = leaf_budgets(leaves, levels, weights, part_of_all, epochs)
    plan = plan.withColumn("whole", F.floor(F.col("budget") / F.col("tokens")).cast("int")).withColumn("rest", F.col("budget") - F.col("whole") * F.col("tokens")).withColumn("ranges", F.ceil(F.sqrt("docs")))
    plan = stored(plan.select(*levels, "whole", "rest", "ranges").where("whole > 0 or rest > 0"))
    dealt = rows.join(plan, levels)
    key = place(seed, F.col("whole"), F.col("name"))
    dealt = dealt.withColumn("key", key).withColumn("range", F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("double") / float(1 << 32) * F.col("ranges")).cast("bigint"))
    sums = dealt.where("rest > 0").groupBy(*levels, "range").agg(F.sum("n_tokens").alias("sum"))
    ordered = Window.partitionBy(*levels).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("sum").over(ordered), F.lit(0)))
    part = dealt.where("rest > 0").join(sums, [*levels, "range"]).where("before < rest")
    inside = part.where("before + sum <= rest").select("doc_id", *levels, F.col("whole").alias("epoch"), "n_tokens", F.col("n_tokens").alias("take_tokens"))
    running = Window.partitionBy(*levels).orderBy("key", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    cut = part.where("before + sum > rest").withColumn("start", F.col("before") + F.coalesce(F.sum("n_tokens").over(running), F.lit(0))).where("start < rest")
    cut = cut.select("doc_id", *levels, F.col("whole").alias("epoch"), "n_tokens", F.least("n_tokens", F.col("rest") - F.col("start")).alias("take_tokens"))
    full = dealt.where("whole > 0").select("doc_id", *levels, F.explode(F.sequence(F.lit(0), F.col("whole") - 1)).alias("epoch"), "n_tokens", F.col("n_tokens").alias("take_tokens"))
    return full.unionByName(inside).unionByName(cut)
