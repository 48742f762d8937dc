"""Exact nearest sign codes by multi-index hashing.

Codes are cut into parts; the stored index has a row per code and part, bucketed by part and value. By the pigeonhole rule, a
code that differs from a query in less than m * (r + 1) bits differs in at most r bits in one of its m parts. So probing all
values within r flips of each part finds every code up to m * (r + 1) - 1 bits away. Queries go from radius to radius until
that holds k codes. A query whose probes would cost more than to compare all codes is compared with them all, which is exact
as well; so the index pays where the k nearest codes are near, or the codes are very many.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce
from itertools import combinations
from math import comb

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shotweave.functions.vectors import WORD, hamming
from shotweave.operators.ranking import top_k
from shotweave.sources.scratch import shared_dir, stored


#: A probe, which is a row of a join, takes as long as so many comparisons of a scan.
PROBE_COST = 4
#: A task of the join sorts about so many probes, or rows of the table; their number of tasks grows with them.
TASK_ROWS = 500_000


def widths(words: int, bits: int) -> list[tuple[int, int, int]]:
    """(word, shift, width) of the parts: every word is cut into pieces of about `bits`."""
    pieces = max(1, round(WORD / bits))
    own = [WORD // pieces + (i < WORD % pieces) for i in range(pieces)]
    return [(w, sum(own[i + 1 :]), own[i]) for w in range(words) for i in range(pieces)]


def parts_of(code: Column, cuts: list[tuple[int, int, int]]) -> Column:
    return F.array(*[F.shiftrightunsigned(F.get(code, F.lit(w)), s).bitwiseAND(F.lit((1 << n) - 1).cast("bigint")) for w, s, n in cuts])


@dataclass
class CodeIndex:
    """(part, value, model_id, key, code, parts) of all codes, stored and bucketed by (part, value)."""

    table: DataFrame
    codes: DataFrame
    cuts: list[tuple[int, int, int]]
    rows: int

    @staticmethod
    def build(spark: SparkSession, codes: DataFrame, key: str, words: int, bits: int | None = None, buckets: int | None = None) -> CodeIndex:
        """codes: (key, model_id, code) with `words` words each; other codes and null ones are left out. Parts have about
        log2(rows) bits, so that a value has about one code."""
        own = stored(codes.where(F.size("code") == words).select(F.col(key).alias("key"), "model_id", "code"))
        n = own.count()
        cuts = widths(words, bits or max(8, n.bit_length()))
        buckets = buckets or max(8, -(-n * len(cuts) // 4_000_000))
        rows = own.withColumn("parts", parts_of(F.col("code"), cuts)).select("model_id", "key", "code", "parts", F.posexplode("parts").alias("part", "value"))
        name = f"codes_{uuid.uuid4().hex}"
        deal = F.pmod(F.hash("part", "value"), F.lit(buckets))
        rows.repartition(deal).write.bucketBy(buckets, "part", "value").sortBy("part", "value").option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
        return CodeIndex(spark.table(name), own, cuts, n)

    def nearest(self, queries: DataFrame, k: int, scan, probe_cost: int = PROBE_COST) -> tuple[DataFrame, int]:
        """((query_id, model_id, key, bits, rank), rows compared): exactly the k nearest codes of each query's model, ties by key.

        queries: (query_id, model_id, code). `scan(queries, k)` gives (query_id, model_id, key, bits) for queries that leave the index.
        """
        m, widest = len(self.cuts), max(n for _, _, n in self.cuts)
        q = stored(queries.where("code is not null").select("query_id", "model_id", F.col("code").alias("own"), parts_of(F.col("code"), self.cuts).alias("own_parts")))
        left, found, read = q, [], 0
        for radius in range(widest + 1):
            probes = m * sum(comb(widest, i) for i in range(radius + 1))
            if probes * probe_cost > self.rows:
                break
            new = stored(self._met(left, radius))
            found.append(new)
            read += new.count()
            every = reduce(DataFrame.unionByName, found)
            done = every.where(F.col("bits") < m * (radius + 1)).groupBy("query_id", "model_id").agg(F.count("*").alias("n")).where(F.col("n") >= k)
            left = stored(left.join(done.select("query_id", "model_id"), ["query_id", "model_id"], "left_anti"))
            if left.isEmpty():
                break
        open_queries = left.count()
        read += open_queries * self.rows
        every = reduce(DataFrame.unionByName, found) if found else None
        if open_queries:
            rest = scan(left.select("query_id", "model_id", F.col("own").alias("code")), k)
            every = every.join(left.select("query_id", "model_id"), ["query_id", "model_id"], "left_anti").unionByName(rest) if found else rest
        return top_k(every, ["query_id", "model_id"], k, F.col("bits"), F.col("key")), read

    def _met(self, q: DataFrame, radius: int) -> DataFrame:
        """(query_id, model_id, key, bits): codes whose nearest part is `radius` flips away; each code once, by its first such part."""
        widest = max(n for _, _, n in self.cuts)
        masks = [sum(1 << i for i in c) for c in combinations(range(widest), radius)]  # PROBE_COST bounds their number
        width = F.array(*[F.lit(n) for _, _, n in self.cuts])
        probe = q.select("*", F.posexplode("own_parts").alias("part", "v")).withColumn("flip", F.explode(F.lit(masks).cast("array<bigint>")))
        probe = probe.where(F.col("flip") < F.call_function("shiftleft", F.lit(1).cast("bigint"), F.get(width, F.col("part"))))
        probe = probe.select("query_id", "model_id", "own", "own_parts", "part", F.col("v").bitwiseXOR(F.col("flip")).alias("value"))
        tasks = -(-max(q.count() * len(self.cuts) * len(masks), self.rows * len(self.cuts)) // TASK_ROWS) or 1
        deal = lambda df: df.repartition(tasks, "part", "value", "model_id")
        hits = deal(self.table).join(deal(probe).hint("merge"), ["part", "value", "model_id"])  # never broadcast: probes are many times the queries
        apart = F.zip_with("parts", "own_parts", lambda a, b: F.bit_count(a.bitwiseXOR(b)))
        first = F.forall(F.transform(apart, lambda d, i: (d > radius) | ((d == radius) & (i >= F.col("part")))), lambda x: x)
        return hits.where(first).select("query_id", "model_id", "key", hamming(F.col("code"), F.col("own")).alias("bits"))
