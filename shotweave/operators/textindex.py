"""A stored text index: postings with positions, bucketed by token, in segments that are appended and merged.

A text belongs to a block by its length and a hash of its key, long texts first, so that counts of a word are alike within a
block. The table of block maxima holds (token, block, most, texts). A top-k search reads the blocks with the largest bounds
first; their k-th score is the bar, and of the other blocks only those whose bound reaches it are read, so the result is that
of a full search. Only the buckets of the searched tokens are read, and the texts themselves never.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shotweave.functions.text import cover_rank, lexemes
from shotweave.operators.ranking import rank_list, top_k
from shotweave.sources.scratch import stored

#: Texts per block, at most so on average; classes of length, each twice as long as the one below.
BLOCK_TEXTS, CLASSES = 1024, 40
#: Up to so many different tokens, or rows of words, are looked up by value; with more, tables are joined by shuffles.
LISTED = 2000
#: A bucket holds the postings of about so many characters, and the blocks of a token are dealt over so many parts of it.
BUCKET_CHARS, SPREAD = 16_000_000, 4
#: A task writes the postings of about so many characters.
TASK_CHARS = 4_000_000
#: A task groups the words of about so many characters; its postings are ten times as large and are spilled if memory does not hold them.
READ_CHARS = 16_000_000
#: So many words are grouped at once, a text's words always together.
GROUP_WORDS = 1_000_000


def cover_score(n: Column) -> Column:
    return F.round(cover_rank(n), 6)


@dataclass
class TextIndex:
    """The index at `path`, with the segments of the version that was the last when it was opened, or of its own last change."""

    spark: SparkSession
    path: str
    live: list[tuple] | None = None

    # ---- writing

    def append(self, texts: DataFrame, key: str, text: str, buckets: int | None = None) -> TextIndex:
        """Adds a segment of texts whose keys are new; null keys and texts without words have no postings."""
        read = texts.groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length(text)), F.lit(0)).alias("chars"))
        n, chars, largest = read.agg(*[F.coalesce(x, F.lit(0)) for x in (F.sum("n"), F.sum("chars"), F.max("chars"))]).first()
        blocks = -(-n // BLOCK_TEXTS) or 1
        buckets = buckets or max(8, chars // BUCKET_CHARS)
        own = texts.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"))
        if largest > 2 * READ_CHARS:  # files can be few and large: texts are dealt before their postings outgrow a task
            own = own.repartition(-(-chars // READ_CHARS), "key")
        words = own.select("key", lexemes(F.col("text")).alias("w"))
        level = F.lit(CLASSES) - F.floor(F.log2(F.greatest(F.size("w"), F.lit(1)))).cast("int")
        block = (level * F.lit(blocks) + F.pmod(F.xxhash64("key"), F.lit(blocks))).cast("bigint")
        rows = grouped_words(words.select("key", block.alias("block"), "w"))
        # the only exchange of words is that for the files, of a row per text and word; its tasks grow in number with the texts
        tasks = min(buckets * SPREAD, -(-chars // TASK_CHARS) or 1)
        # most words stand once in a text, and a place alone is a third of what a list of one is there
        rows = rows.select("token", "block", "key", F.get("positions", F.lit(0)).alias("at"), F.when(F.col("n") > 1, F.slice("positions", 2, F.col("n") - 1)).alias("more"))
        rows = rows.repartition(tasks, F.pmod(F.hash("token"), F.lit(buckets)), F.pmod("block", F.lit(SPREAD)))
        rows = rows.withColumn("positions", F.when(F.col("more").isNull(), F.array("at")).otherwise(F.concat(F.array("at"), "more"))).select("token", "block", "key", F.size("positions").alias("n"), "positions")
        name = self._write(rows, "postings", buckets)
        maxima = self._open(name, "postings", rows.schema.simpleString(), buckets).groupBy("token", "block").agg(F.max("n").alias("most"), F.count("*").alias("texts"))
        self._write(maxima, "blocks", buckets, name)
        self._commit([*self._segments(), (name, buckets, rows.schema.simpleString(), maxima.schema.simpleString())])
        return self

    def merge(self, buckets: int | None = None) -> TextIndex:
        """Makes one segment of all; blocks of different segments stay apart, so bounds stay as tight as they were."""
        live = self._segments()
        if len(live) < 2:
            return self
        buckets = buckets or max(b for _, b, _, _ in live)
        number = F.col("block") * len(live) + F.col("segment")
        rows = self.postings(None).withColumn("block", number).select("token", "block", "key", "n", "positions")
        maxima = self.blocks().withColumn("block", number).select("token", "block", "most", "texts")
        deal = [F.pmod(F.hash("token"), F.lit(buckets)), F.pmod(F.col("block"), F.lit(SPREAD))]
        name = self._write(rows.repartition(*deal), "postings", buckets)
        self._write(maxima.repartition(*deal), "blocks", buckets, name)
        self._commit([(name, buckets, rows.schema.simpleString(), maxima.schema.simpleString())])
        return self

    def _write(self, df: DataFrame, what: str, buckets: int, name: str | None = None) -> str:
        name = name or uuid.uuid4().hex
        df.write.bucketBy(buckets, "token").sortBy("token", "block").option("path", f"{self.path}/{name}/{what}").saveAsTable(f"{what}_{name}")
        return name

    # ---- versions: a row per live segment; readers take the last complete one

    def _commit(self, segments: list[tuple]) -> None:
        version = self._version() + 1
        self.spark.createDataFrame(segments, "name string, buckets int, postings string, blocks string").coalesce(1).write.parquet(f"{self.path}/versions/version={version}")
        self.live = segments

    def _version(self) -> int:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/versions")
        files = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not files.exists(folder):
            return 0
        done = [f.getPath() for f in files.listStatus(folder) if files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))]
        return max([int(p.getName().split("=")[1]) for p in done], default=0)

    def _segments(self) -> list[tuple]:
        if self.live is None:
            version = self._version()
            self.live = [tuple(r) for r in self.spark.read.parquet(f"{self.path}/versions/version={version}").collect()] if version else []
        return self.live

    def _open(self, name: str, what: str, schema: str, buckets: int) -> DataFrame:
        """The bucketed table of a segment, registered anew if this session does not know it."""
        table = f"{what}_{name}"
        if not self.spark.catalog.tableExists(table):
            columns = schema.removeprefix("struct<").removesuffix(">").replace(":", " ")
            columns = columns.replace("array <", "array<")
            self.spark.sql(f"create table {table} ({columns}) using parquet clustered by (token) sorted by (token, block) into {buckets} buckets location '{self.path}/{name}/{what}'")
        return self.spark.table(table)

    # ---- reading

    def _tables(self, what: str, tokens: list[str] | None) -> list[DataFrame]:
        out = []
        for i, (name, buckets, postings, blocks) in enumerate(self._segments()):
            x = self._open(name, what, postings if what == "postings" else blocks, buckets)
            out.append((x.where(F.col("token").isin(tokens)) if tokens is not None else x).withColumn("segment", F.lit(i)))
        return out

    def postings(self, tokens: list[str] | None = None, last: dict[int, int] | None = None) -> DataFrame:
        """(token, block, key, n, positions, segment) of listed tokens: their buckets only; of blocks up to `last` by segment."""
        parts = self._tables("postings", tokens)
        if last is not None:
            parts = [p.where(F.col("block") <= last[i]) for i, p in enumerate(parts) if i in last]
        return reduce(DataFrame.unionByName, parts)

    def blocks(self, tokens: list[str] | None = None) -> DataFrame:
        return reduce(DataFrame.unionByName, self._tables("blocks", tokens))

    def top(self, words: DataFrame, by: str, k: int, keep: Callable[[DataFrame], DataFrame] = lambda x: x, floor: float = 0.0) -> DataFrame:
        """The best k texts of each `by`, in order of score and key, out of those that `keep` leaves.

        words: (by, token). `keep` takes (by, key, score) and may add columns; it is applied before the cut. Texts below `floor` have no place.
        """
        words, tokens = looked_up(words.select(by, "token").distinct())
        place = ["segment", "block"]
        bounds = self.blocks(tokens).join(words, "token").groupBy(by, *place).agg(F.sum("most").alias("most"), F.max("texts").alias("texts"))
        best = top_k(bounds, [by], 4 * k, F.col("most").desc(), *map(F.col, place)).withColumnRenamed("rank", "nth")
        before = F.sum("texts").over(Window.partitionBy(by).orderBy("nth").rowsBetween(Window.unboundedPreceding, -1))
        first = best.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < 4 * k).select(by, *place)
        found = stored(top_k(self._scored(words, first, tokens, by, keep, floor), [by], k, F.col("score").desc(), F.col("key")).drop("rank"))
        bar = found.groupBy(by).agg(F.when(F.count("*") >= k, F.min("score")).otherwise(F.lit(0.0)).alias("bar"))
        live = bounds.join(bar, by, "left").where(cover_score(F.col("most")) >= F.coalesce("bar", F.lit(0.0))).join(first, [by, *place], "left_anti").select(by, *place)
        last = {r["segment"]: r["m"] for r in live.groupBy("segment").agg(F.max("block").alias("m")).collect()}  # a row per segment
        if last:
            found = found.unionByName(self._scored(words, live, tokens, by, keep, floor, last))
        return top_k(found, [by], k, F.col("score").desc(), F.col("key"))

    def _scored(self, words: DataFrame, where: DataFrame, tokens: list[str] | None, by: str, keep: Callable, floor: float, last: dict[int, int] | None = None) -> DataFrame:
        lists = words.join(where, by)
        hits = self.postings(tokens, last).select("token", "segment", "block", "key", "n").join(lists, ["token", "segment", "block"])
        score = cover_score(F.col("n"))
        return keep(hits.groupBy(by, "key").agg(F.sum("n").alias("n")).select(by, "key", score.alias("score")).where(F.col("score") >= floor))

    def phrases(self, lists: DataFrame) -> DataFrame:
        """(tokens, key, n): how often the words of each list (tokens) stand next to each other in a text."""
        words, tokens = looked_up(word_rows(lists))
        places = self.postings(tokens).select("token", "key", F.explode("positions").alias("pos"))
        return adjacent(places, words, self.blocks(tokens).groupBy("token").agg(F.sum("texts").alias("n")))


def index_name(*parts: str) -> str:
    return "text-index-" + hashlib.sha256("\n".join(parts).encode()).hexdigest()[:24]


def looked_up(words: DataFrame) -> tuple[DataFrame, list[str] | None]:
    """(words, tokens): a table of up to LISTED rows as a local one to broadcast, with its different tokens; a larger one stored,
    to be joined by a shuffle, and None."""
    rows = words.limit(LISTED + 1).collect()
    if len(rows) > LISTED:
        return stored(words).hint("merge"), None
    return F.broadcast(words.sparkSession.createDataFrame(rows, words.schema)), sorted({r["token"] for r in rows if r["token"] is not None})


def word_rows(lists: DataFrame) -> DataFrame:
    """(tokens, size, off, token): the words of each different list."""
    return lists.select("tokens").distinct().select("tokens", F.size("tokens").alias("size"), F.posexplode("tokens").alias("off", "token"))


def grouped_words(words: DataFrame) -> DataFrame:
    """(key, block, token, n, positions): each text's different words with their places, grouped where the text is read.

    words: key, block, w (the words in order). A text is one row, so grouping needs no exchange of its words.
    """

    def group(keys: pa.Array, blocks: pa.Array, w: pa.Array) -> pa.RecordBatch:
        size = pa.compute.fill_null(pa.compute.list_value_length(w), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = w.flatten().dictionary_encode()
        row = np.repeat(np.arange(len(size)), size)
        place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
        of = row * max(1, len(coded.dictionary)) + coded.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(of, kind="stable")  # by text and word, places in order
        of = of[order]
        first = np.flatnonzero(np.concatenate([np.ones(min(1, len(of)), dtype=bool), of[1:] != of[:-1]]))
        ends = np.append(first, len(of)).astype(np.int32)
        own, token = order[first], coded.indices.take(pa.array(order[first]))
        columns = [keys.take(pa.array(row[own])), blocks.take(pa.array(row[own])), coded.dictionary.take(token), pa.array(np.diff(ends)), pa.ListArray.from_arrays(pa.array(ends), pa.array(place[order].astype(np.int32)))]
        return pa.RecordBatch.from_arrays(columns, names=["key", "block", "token", "n", "positions"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = np.cumsum(pa.compute.fill_null(pa.compute.list_value_length(batch.column(2)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            lo = 0
            while lo < batch.num_rows:
                hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + GROUP_WORDS, "right")))
                yield group(*batch.slice(lo, hi - lo).columns)
                lo = hi

    return words.mapInArrow(run, f"key {words.schema['key'].dataType.simpleString()}, block bigint, token string, n int, positions array<int>")


def text_places(texts: DataFrame, text: str, key: str, words: DataFrame, tokens: list[str] | None) -> DataFrame:
    """(token, key, pos): where searched tokens stand in texts that have no index; stored, as phrases read it often."""
    rows = texts.select(F.col(key).alias("key"), F.posexplode(lexemes(F.col(text))).alias("pos", "token"))
    rows = rows.where(F.col("token").isin(tokens)) if tokens is not None else rows.join(words.select("token").distinct().hint("merge"), "token", "left_semi")
    return stored(rows.select("token", "key", "pos"))


def adjacent(places: DataFrame, words: DataFrame, frequency: DataFrame) -> DataFrame:
    """(tokens, key, n): phrases by a positional join.

    places: (token, key, pos), words: as word_rows gives them, frequency: (token, n). The rarest word of a phrase leads: each
    of its places is a start, and every other word must stand at the start plus its offset. A word that no text holds ends its phrase.
    """
    counted = words.join(frequency, "token", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    ranked, tokens = looked_up(rank_list(counted, ["tokens"], F.col("n"), F.col("off")))  # a row per word of a phrase
    how = F.broadcast if tokens is not None else lambda x: x.hint("merge")
    lead = how(ranked.where("rank = 1 and n > 0").select("tokens", "size", "off", "token"))
    starts = places.join(lead, "token").select("tokens", "size", "key", (F.col("pos") - F.col("off")).alias("start")).where("start >= 0")
    rest = how(ranked.where("rank > 1").select("tokens", "off", "token"))
    wanted = starts.where("size > 1").join(rest, "tokens").select("tokens", "size", "key", "start", "token", (F.col("start") + F.col("off")).alias("pos"))
    met = wanted.join(places.hint("merge"), ["key", "token", "pos"]).groupBy("tokens", "size", "key", "start").agg(F.count("*").alias("met")).where(F.col("met") == F.col("size") - 1)
    whole = starts.where("size = 1").select("tokens", "key").unionByName(met.select("tokens", "key"))
    return whole.groupBy("tokens", "key").agg(F.count("*").alias("n"))
