"""Queries that ask the same are searched once; each gets the rows of the one that was."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotweave.sources.scratch import stored

#: Found rows up to this number are sent to all tasks: one query can stand for very many, and would be one task in a shuffle.
MOST_SHARED = 500_000


@dataclass(frozen=True)
class Once:
    """The queries to search for, and `members` (query_id, first): the one that each query shares its rows with."""

    first: DataFrame
    members: DataFrame
    count: int

    def given(self, found: DataFrame, each: int | None = None) -> DataFrame:
        """`found` (query_id, ...) for all queries. `each` is the most rows of one query, if there is such a limit."""
        x = found.withColumnRenamed("query_id", "first")
        few = each is not None and self.count * each <= MOST_SHARED
        return (F.broadcast(x) if few else x).join(self.members, "first").select(*found.columns)


def once(queries: DataFrame, same: DataFrame) -> Once:
    """queries: one or several rows of a query_id; same: (query_id, same), equal where queries ask the same."""
    firsts = same.groupBy("same").agg(F.min("query_id").alias("first"))
    members = stored(same.join(firsts, "same").select("query_id", "first"))
    own = stored(members.select(F.col("first").alias("query_id")).distinct())
    return Once(queries.join(own, "query_id", "left_semi"), members, own.count())


def once_by(queries: DataFrame, by: list[str]) -> Once:
    """Queries of one row each, which ask the same where all columns `by` are equal."""
    return once(queries, queries.select("query_id", _name(F.struct(*by)).alias("same")))


def once_by_rows(rows: DataFrame, order: str) -> Once:
    """Queries of several rows each, told apart by `order`: they ask the same where all their rows are equal."""
    row = F.struct(order, *[c for c in rows.columns if c not in ("query_id", order)])
    every = rows.groupBy("query_id").agg(F.sort_array(F.collect_list(row)).alias("rows"))  # a query's rows are few
    return once(rows, every.select("query_id", _name(F.struct("rows")).alias("same")))


def _name(asked) -> F.Column:
    return F.sha2(F.to_json(asked), 256)
