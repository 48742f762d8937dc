"""Scans in order over keys of any size: ranges of the order are scanned on their own, and borders are carried over.

A key is cut into ranges of its order. Windows run inside (key, range); then one small row per range carries what the ranges
before it hand over. So a key with very many rows is many tasks, and only its borders, a row per range, meet in one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _ranged(df: DataFrame, keys: list[str], place: Column) -> tuple[DataFrame, list[str]]:
    return df.withColumn("range_", place), [*keys, "range_"]


def _with_borders(df: DataFrame, borders: DataFrame, names: list[str]) -> DataFrame:
    """Joins what each range takes over; null keys are keys like others."""
    own = borders.select(*[F.col(c).alias(f"{c}__") for c in names], "carried_")
    same = [F.col(c).eqNullSafe(F.col(f"{c}__")) for c in names]
    on = same[0]
    for c in same[1:]:
        on = on & c
    return df.join(own, on, "left").drop(*[f"{c}__" for c in names])


def with_previous(df: DataFrame, keys: list[str], place: Column, order: list[str], value: Column, out: str) -> DataFrame:
    """Adds `out`: `value` of the row before, by `order` inside the keys; null for a key's first row.

    `place` is the number of a row's range; it must not fall as the order rises.
    """
    x, names = _ranged(df, keys, place)
    x = x.withColumn("value_", F.struct(value.alias("v")))
    inside = Window.partitionBy(*names).orderBy(*order)
    x = x.withColumn("before_", F.lag("value_").over(inside))
    last = x.groupBy(*names).agg(F.max_by("value_", F.struct(*order)).alias("last_"))
    borders = last.withColumn("carried_", F.lag("last_").over(Window.partitionBy(*keys).orderBy("range_"))).drop("last_")
    x = _with_borders(x, borders, names)
    return x.withColumn(out, F.coalesce("before_", "carried_")["v"]).drop("range_", "value_", "before_", "carried_")


def with_running_sum(df: DataFrame, keys: list[str], place: Column, order: list[str], value: Column, out: str) -> DataFrame:
    """Adds `out`: the sum of `value` over the rows of the keys up to this one, by `order`."""
    x, names = _ranged(df, keys, place)
    x = x.withColumn("value_", value)
    x = x.withColumn("inside_", F.sum("value_").over(Window.partitionBy(*names).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    earlier = Window.partitionBy(*keys).orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    borders = x.groupBy(*names).agg(F.sum("value_").alias("sum_")).withColumn("carried_", F.sum("sum_").over(earlier)).drop("sum_")
    x = _with_borders(x, borders, names)
    return x.withColumn(out, F.coalesce("inside_", F.lit(0)) + F.coalesce("carried_", F.lit(0))).drop("range_", "value_", "inside_", "carried_")
